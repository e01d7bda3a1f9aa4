"""BPE encoding and decoding by a tokenization automaton.

The automaton reads tokens and accepts exactly the correct tokenizations. It starts
as one state with a loop for each byte. Each merge (u, v), in order of priority,
applies the merge gadget: the state that u-arcs lead to is copied without its v-arc
(u followed by v is never correct again), the u-arcs move to the copy, and every
state with a u-arc gets an arc for uv that leads where the v-arc led. Since all arcs
of a token lead to one state, states are kept as differences: what arc was lost at
which merge. The transition table over tokens, of which a vocabulary has more entries
than fit, is filled from the differences where a word first needs an entry; the table
over the bytes of the labels is whole. Every prefix of a word has one correct
tokenization, so each byte offset of a word has one state, and encoding is one walk
forward without backtracking; decoding emits the labels of the arcs.
"""

import hashlib
import json
from array import array
from sys import byteorder

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docgauge.llm.common import by_position, give_back
from docgauge.llm.pretokens import Splitter

#: Words remembered by a task; beyond it the memory starts anew.
REMEMBERED = 400_000
#: Rows that are encoded and returned at once.
ROWS = 256


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary file."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    shifted = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(shifted)}


class Automaton:
    """The compiled automaton of a list of merges.

    ``labels[t]`` is the byte string of token t. All arcs of token t lead to state t
    (one start state besides). ``lacking[u, v]`` is the merge since which the state of u
    has no v-arc, and ``made[uv]`` the merge that made a token, with its two parts: when
    made, the state of uv was the state of v at that time.
    """

    def __init__(self, labels: dict[int, bytes], merges: list[tuple[int, int, int]]):
        self.labels = labels
        self.ids = {label: t for t, label in labels.items() if len(label) == 1}
        self.lacking: dict[tuple[int, int], int] = {}
        self.made: dict[int, tuple[int, int, int]] = {}
        for k, (u, v, uv) in enumerate(merges, 1):
            self._gadget(k, u, v, uv)
        self._compile()

    def _compile(self) -> None:
        """The transition table over bytes: (node, byte) to node, and the token that a node ends."""
        self.step: dict[int, int] = {}
        self.ends = [-1]
        for label, token in self.ids.items():
            node = 0
            for byte in label:
                key = node << 8 | byte
                node = self.step.get(key)
                if node is None:
                    node = self.step[key] = len(self.ends)
                    self.ends.append(-1)
            self.ends[node] = token
        self.arcs: dict[int, bool] = {}

    def _gadget(self, k: int, u: int, v: int, uv: int) -> None:
        """Merge k: the state of u loses its v-arc; states with a u-arc gain a uv-arc."""
        parts = all(self.ids.get(self.labels[t]) == t for t in (u, v))
        if parts and self.has_arc(u, v):  # else v never follows u, and the merge never applies
            self.lacking[u, v] = k
            self.made[uv] = (k, u, v)
            self.ids[self.labels[uv]] = uv

    def has_arc(self, u: int, t: int) -> bool:
        """Whether the state of u has an arc for token t.

        The state of u lacks what u lost as a left part, and what the state of its right
        part lacked when u was made. An arc for t is where the arc of its left part was
        when t was made.
        """
        lacking, made = self.lacking.get, self.made.get
        since = len(self.labels)
        while True:
            arc, until = t, since
            while True:
                lost = lacking((u, arc))
                if lost is not None and lost <= until:
                    return False
                part = made(arc)
                if part is None:
                    break
                if part[0] < until:
                    until = part[0]
                arc = part[1]
            part = made(u)
            if part is None:
                return True
            if part[0] <= since:
                since = part[0] - 1
            u = part[2]

    def _follows(self, u: int, t: int) -> bool:
        """The entry of (u, t) in the transition table, filled in at its first use."""
        key = u << 32 | t
        known = self.arcs.get(key)
        if known is None:
            if len(self.arcs) >= REMEMBERED:
                self.arcs.clear()
            known = self.arcs[key] = self.has_arc(u, t)
        return known

    def encode(self, word: bytes) -> list[int]:
        """The tokens of one pre-split word, in one walk forward.

        ``last[e]`` is the state after the bytes up to e, the last token of their only
        correct tokenization. From each state the arcs for the tokens that the word has
        there are taken, and every one that exists sets the state at its end for good.
        """
        whole = self.ids.get(word)
        if whole is not None:  # the start state lacks no arc
            return [whole]
        step, ends, follows, n = self.step.get, self.ends, self._follows, len(word)
        last = [-1] * (n + 1)
        for at in range(n):
            state, node = last[at], 0
            for end in range(at, n):
                node = step(node << 8 | word[end])
                if node is None:
                    break
                token = ends[node]
                if token >= 0 and last[end + 1] < 0 and (at == 0 or follows(state, token)):
                    last[end + 1] = token
        out, end = [], n
        while end:
            out.append(last[end])
            end -= len(self.labels[last[end]])
        return out[::-1]


class Codec:
    """Text to token ids and back, for one byte-level vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        letters = byte_letters()
        vocabulary = model["vocab"]
        labels = {i: bytes(letters[c] for c in token) for token, i in vocabulary.items()}
        pairs = [m.split(" ", 1) if isinstance(m, str) else m for m in model["merges"]]
        merges = [(vocabulary[a], vocabulary[b], vocabulary[a + b]) for a, b in pairs]
        self.automaton = Automaton(labels, merges)
        self.split = Splitter(path)
        everything = labels | {i: s.encode() for s, i in self.split.special.items()}
        self.labels = [everything.get(i, b"") for i in range(max(everything, default=-1) + 1)]
        self.words: dict[str, bytes] = {}
        self.chunks: dict[str, bytes] = {}

    def _word(self, word: str) -> bytes:
        known = self.words.get(word)
        if known is None:
            special = self.split.special.get(word)
            ids = array("I", [special] if special is not None else self.automaton.encode(word.encode("utf-8")))
            if byteorder == "big":
                ids.byteswap()
            known = ids.tobytes()
            _remember(self.words, word, known)
        return known

    def _chunk(self, chunk: str) -> bytes:
        known = b"".join([self._word(w) for w in self.split.plain(" " + chunk)])
        _remember(self.chunks, chunk, known)
        return known

    def encode(self, text: str) -> bytes:
        """Token ids as little-endian unsigned 32-bit integers."""
        chunks = self.split.chunks(text)
        if chunks is None:
            return b"".join([self._word(w) for w in self.split(text)])
        known, new = self.chunks.get, self._chunk
        first = [self._word(w) for w in self.split.plain(chunks[0])]
        return b"".join(first + [known(c) or new(c) for c in chunks[1:]])

    def decode(self, packed: bytes) -> str:
        """The labels of the arcs in order; bytes that are no UTF-8 become U+FFFD."""
        labels = self.labels
        return b"".join([labels[i] for i in np.frombuffer(packed, "<u4").tolist()]).decode("utf-8", "replace")

    def forget(self) -> None:
        """Drop all that was remembered of words."""
        for known in (self.words, self.chunks, self.automaton.arcs):
            known.clear()


def _remember(known: dict, key: str, value: bytes) -> None:
    """Keep a result for short keys; a full memory starts anew."""
    if len(key) <= 64:
        if len(known) >= REMEMBERED:
            known.clear()
        known[key] = value


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """The codec of a vocabulary file, compiled once in each worker."""
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and (keep_ids) the ids of each row.

    One pass over the rows, no shuffle. A null text counts as empty: no tokens, and the
    digests of nothing. Repeated rows stay; other columns are not read.
    """
    df, at = by_position(docs)
    df = df.select(F.col(at[id_col]).alias("doc_id"), F.coalesce(F.col(at[text_col]).cast("string"), F.lit("")).alias("text"))
    kind = df.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary" * keep_ids

    def run(batches):
        import pyarrow as pa

        own = codec(path)
        try:
            for batch in batches:
                for k in range(0, batch.num_rows, ROWS):
                    part = batch.slice(k, ROWS)
                    counts, sums, back, held = [], [], [], []
                    for text in part.column("text"):
                        packed = own.encode(text.as_py())
                        counts.append(len(packed) // 4)
                        sums.append(hashlib.sha256(packed).hexdigest())
                        back.append(hashlib.sha256(own.decode(packed).encode("utf-8")).hexdigest())
                        held.append(packed if keep_ids else None)
                    columns = [part.column("doc_id"), pa.array(counts, pa.int64()), pa.array(sums, pa.string()), pa.array(back, pa.string())]
                    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                    if keep_ids:
                        columns, names = [*columns, pa.array(held, pa.binary())], [*names, "ids"]
                    yield pa.RecordBatch.from_arrays(columns, names)
        finally:  # Spark keeps the worker, and the memory it holds, for the tasks of other stages
            own.forget()
            give_back()

    return df.mapInArrow(run, schema)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id and the text of each row's ``ids``; null ids give an empty text."""
    def run(batches):
        import pyarrow as pa

        own = codec(path)
        for batch in batches:
            texts = [own.decode(x.as_py() or b"") for x in batch.column("ids")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    kind = encoded.schema["doc_id"].dataType.simpleString()
    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, text string")
