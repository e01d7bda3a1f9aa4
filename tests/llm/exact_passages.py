"""The exact finder of passages: an item with at most d edits keeps one of d + 1 stretches word for word."""

from collections import Counter, defaultdict

from docgauge.llm.decontaminate import EDITS, distance_ends, words_of


def stretches(m: int, most: int) -> list[tuple[int, int]]:
    """Bounds of most + 1 disjoint stretches that make up m words, as equal as can be."""
    n = most + 1
    return [(m * k // n, m * (k + 1) // n) for k in range(n)]


class Exact:
    """The stretches of some items, found by their rarest words."""

    def __init__(self, items: list[tuple], edits: float = EDITS):
        if not 0 <= edits < 1:
            raise ValueError("edits must be a share from 0 to below 1: with all words edited, every text matches")
        self.items = [(key, w) for key, text in items if (w := words_of(text))]
        self.sets = [frozenset(words) for _, words in self.items]
        self.edits = edits
        #: Items and offsets of each stretch; words before and from the rarest word of the stretches that it stands for.
        self.places: dict[tuple, list[tuple[int, int]]] = defaultdict(list)
        self.shapes: dict[str, set[tuple[int, int]]] = defaultdict(set)
        often = Counter(w for _, words in self.items for w in words)
        for number, (_, words) in enumerate(self.items):
            for low, high in stretches(len(words), int(edits * len(words))):
                # words that are rare in the benchmark and long: few places of the corpus hold them
                rarest = min(range(low, high), key=lambda k: (often[words[k]], -len(words[k]), k))  # noqa: B023
                self.shapes[words[rarest]].add((rarest - low, high - rarest))
                self.places[tuple(words[low:high])].append((number, low))

    def matches(self, text: str) -> list[tuple]:
        """(item key, first word, last word + 1, distance, item words) of each passage found, by item and place."""
        words = words_of(text)
        shapes, places, tried, found = self.shapes, self.places, set(), {}
        for at in [k for k, w in enumerate(words) if w in shapes]:
            for before, after in shapes[words[at]]:
                start = at - before
                if start < 0:
                    continue
                for number, offset in places.get(tuple(words[start:at + after]), ()):
                    if (number, start - offset) in tried:
                        continue
                    tried.add((number, start - offset))
                    key, item = self.items[number]
                    most = int(self.edits * len(item))
                    low = max(0, start - offset - most)
                    window = words[low:start - offset + len(item) + most]
                    if len(self.sets[number].difference(window)) > most:
                        continue
                    distance, end = distance_ends(item, window)
                    if distance <= most:
                        _, size = distance_ends(item[::-1], words[low:low + end][::-1])
                        span = (low + end - size, low + end)
                        best = found.get((number, span[1]))
                        if best is None or distance < best[3]:
                            found[number, span[1]] = (key, *span, distance, len(item))
        return sorted(found.values(), key=lambda x: (str(x[0]), *x[1:]))
