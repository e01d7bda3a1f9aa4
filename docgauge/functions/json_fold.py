"""JSON texts of any depth, read token by token in folds inside the row.

A text is cut into tokens by one pattern and folded with an explicit stack of open
containers, so the plan is the same whatever the nesting and nothing is looked up in the
data while it is built. A fold copies its state at every step, so the state holds the
open containers only and nothing that grows with the text: tokens are dealt to blocks of
about the square root of their number, a first fold finds the state at the start of each
block, and a second one inside each block gives the block's part of the result. The folds
are SQL text over the state ``s`` and the token ``t``.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What the value of a token is.
OBJECT, LIST, END, TEXT, NUMBER_TEXT, BOOLEAN_TEXT, INT, FLOAT, BOOLEAN, NULL = range(1, 11)
#: Bits of the value types, in the order in which they are named.
TYPES = {"NoneType": 1, "bool": 2, "int": 4, "float": 8, "str": 16, "dict": 32, "list": 64}
#: Tokens of a block at least; most texts are one block and skip the first fold.
LEAST_BLOCK = 128
_TEXTS = "array<string>"
# escaped white space, as it stands between quotes
_BLANK = r"(?:\s|\\[ntrf]|\\u0020|\\u000[bB9]|\\u001[c-fC-F]|\\u00[aA]0)*+"


_TOKEN = r'(?:("[^"]*+")\s*+:\s*+)?+("[^"]*+"|[\[\]{}]|[^\s\[\]{},:"]++)'


def tokens(text: Column) -> Column:
    """array<struct<k, key, t>>: each scalar, start and end of a container with its kind, key and spelling.

    Elements of lists and ends have an empty key. Backslashes and quotes inside strings
    are marked first with control characters, which no valid text holds, so that a string
    ends at the next quote.
    """
    marked = F.replace(F.replace(text, F.lit("\\\\"), F.lit("\u0001")), F.lit('\\"'), F.lit("\u0002"))
    part = lambda k: F.regexp_extract_all(marked, F.lit(_TOKEN), F.lit(k))
    others = F.expr(f"array({OBJECT}, {LIST}, {END}, {END}, {NULL}, {BOOLEAN}, {BOOLEAN})")

    def kind(t: Column, key: Column) -> Column:
        kept_as_text = (
            F.when(key == "", TEXT)
            .when(t.rlike(rf'(?U)\A"{_BLANK}-?\d+\.?\d*{_BLANK}"\z'), NUMBER_TEXT)
            .when(t.rlike(rf'(?Ui)\A"{_BLANK}(?:true|false){_BLANK}"\z'), BOOLEAN_TEXT).otherwise(TEXT))
        return (
            F.when(t.startswith('"'), kept_as_text)
            .when(t.rlike(r"\A-?\d"), F.when(t.rlike(r"\A-?\d+\z"), INT).otherwise(FLOAT))
            .otherwise(F.get(others, F.instr(F.lit("{[}]ntf"), F.left(t, F.lit(1))) - 1))
        )

    return F.transform(
        F.arrays_zip(part(1).alias("key"), part(2).alias("t")),
        lambda x: F.struct(kind(x["t"], x["key"]).alias("k"), x["key"].alias("key"), x["t"].alias("t")))


def _plain(t: str) -> str:
    """The characters that a string token stands for."""
    spelled = f"replace(replace({t}, '\\u0002', r'\\\"'), '\\u0001', r'\\\\')"
    return (f"CASE WHEN {t} RLIKE '[\\\\\\\\\\u0001\\u0002]' THEN get(from_json(concat('[', {spelled}, ']'), '{_TEXTS}'), 0) "
            f"ELSE substring({t}, 2, length({t}) - 2) END")


def _struct(fields: dict[str, str]) -> str:
    return "named_struct(" + ", ".join(f"'{n}', {e}" for n, e in fields.items()) + ")"


def _scan(tokens_: str, state: dict[str, str], given: dict[str, str], cases: list[tuple[str, dict[str, str]]], last: tuple = ()) -> str:
    """SQL of one struct of the fields ``given``, and the state's ``last``, for each block of tokens, in order.

    ``state`` and ``given`` hold the start value of each field; a case holds its condition
    and the fields that it changes, and the last one holds where no other does.
    """

    def step(fields):
        branch = [(test, _struct({f: change.get(f, f"s.{f}") for f in fields})) for test, change in cases]
        return "CASE " + " ".join(f"WHEN {test} THEN {made}" for test, made in branch[:-1]) + f" ELSE {branch[-1][1]} END"

    size = f"greatest({LEAST_BLOCK}, cast(sqrt(size({tokens_})) AS int))"
    blocks = f"transform(sequence(0, (size({tokens_}) - 1) div {size}), i -> slice({tokens_}, cast(i * {size} + 1 AS int), {size}))"
    zero = _struct(state)
    starts = (f"aggregate(slice(bs, 1, size(bs) - 1), named_struct('now', {zero}, 'all', filter(array({zero}), x -> false)), "
              f"(o, b) -> named_struct('now', aggregate(b, o.now, (s, t) -> {step(state)}), 'all', concat(o.all, array(o.now))), "
              "o -> concat(o.all, array(o.now)))")
    first = _struct({f: f"ss[i].{f}" for f in state} | given)
    finish = _struct({f: f"s.{f}" for f in (*given, *last)})
    inner = f"transform(bs, (b, i) -> aggregate(b, {first}, (s, t) -> {step(state | given)}, s -> {finish}))"
    return f"get(transform(array({blocks}), bs -> get(transform(array({starts}), ss -> {inner}), 0)), 0)"


# n: elements so far of a list, -1 in an object, -2 at the top
_NEXT = "CASE WHEN s.n >= 0 THEN s.n + 1 ELSE s.n END"
_POPPED = "slice(s.stack, 1, size(s.stack) - 1)"
_OPENS, _ENDS = f"t.k <= {LIST}", f"t.k = {END}"
_KIND = f"CASE t.k WHEN {LIST} THEN 0 ELSE -1 END"


def _top(field: str) -> str:
    return f"element_at(s.stack, -1).{field}"


# ---------------------------------------------------------------- flat text

_PREFIX = f"CASE WHEN s.n >= 0 THEN concat(s.prefix, '[', s.n, '] ') WHEN s.n = -1 THEN concat(s.prefix, {_plain('t.key')}, ': ') ELSE '' END"
_LEAF = (f"CASE t.k WHEN {NULL} THEN 'None' WHEN {BOOLEAN} THEN initcap(t.t) WHEN {INT} THEN t.t WHEN {FLOAT} THEN t.t ELSE {_plain('t.t')} END")


def flat_text(tokens_: str) -> Column:
    """One ``path: value`` line per leaf in source order; an empty container gives an empty line."""
    state = {"prefix": "''", "n": "-2", "opened": "false", "stack": "cast(array() AS array<struct<prefix:string,n:int>>)"}
    cases = [
        (_OPENS, {"prefix": _PREFIX, "n": _KIND, "opened": "true",
                  "stack": f"concat(s.stack, array(named_struct('prefix', s.prefix, 'n', {_NEXT})))"}),
        (_ENDS, {"prefix": _top("prefix"), "n": _top("n"), "opened": "false", "stack": _POPPED,
                 "lines": "CASE WHEN s.opened THEN concat(s.lines, array('')) ELSE s.lines END"}),
        ("", {"n": _NEXT, "opened": "false", "lines": f"concat(s.lines, array(concat({_PREFIX}, {_LEAF})))"}),
    ]
    found = _scan(tokens_, state, {"lines": f"cast(array() AS {_TEXTS})"}, cases)
    return F.expr(f"array_join(flatten(transform({found}, x -> x.lines)), chr(10))")


# ---------------------------------------------------------------- type checks

_BIT = (f"CASE t.k WHEN {OBJECT} THEN {TYPES['dict']} WHEN {LIST} THEN {TYPES['list']} WHEN {INT} THEN {TYPES['int']} WHEN {FLOAT} THEN {TYPES['float']} "
        f"WHEN {BOOLEAN} THEN {TYPES['bool']} WHEN {NULL} THEN {TYPES['NoneType']} ELSE {TYPES['str']} END")
_NAMES = "array_join(filter(array(" + ", ".join(f"CASE WHEN (s.mask & {b}) > 0 THEN '{n}' END" for n, b in TYPES.items()) + "), x -> x IS NOT NULL), ', ')"


def type_checks(tokens_: str) -> Column:
    """struct<done, passed, issues>: checks of the entries of objects and of lists of several elements.

    An entry is one check; a number or boolean kept as text counts half. A list of
    several elements is one check, half for mixed types; a list of one is not looked
    into: what was counted in it is dropped when it ends. Issues are all texts of checks
    that count half, with the path of the value.
    """
    # made: issues so far; a list of one drops those made since it opened
    frame = {"n": "int", "mask": "int", "path": "string", "done": "int", "passed": "double", "made": "int"}
    frames = "array<struct<" + ",".join(f"{n}:{t}" for n, t in frame.items()) + ">>"
    state = {"n": "-2", "mask": "0", "path": "''", "done": "0", "passed": "0D", "made": "0", "stack": f"cast(array() AS {frames})"}
    given = {"issues": "cast(array() AS array<struct<no:int,text:string>>)", "dropped": "cast(array() AS array<struct<a:int,b:int>>)"}
    entry, mask = "CASE WHEN s.n = -1 THEN 1 ELSE 0 END", f"CASE WHEN s.n >= 0 THEN s.mask | {_BIT} ELSE s.mask END"
    counted = {"n": _NEXT, "mask": mask, "path": "s.path", "done": f"s.done + {entry}", "passed": f"s.passed + {entry}", "made": "s.made"}
    path = f"concat(s.path, CASE WHEN s.path = '' THEN '' ELSE '.' END, {_plain('t.key')})"
    half = f"t.k IN ({NUMBER_TEXT}, {BOOLEAN_TEXT})"
    shown = rf"regexp_replace({_plain('t.t')}, r'(?U)^\s+|\s+$', '')"
    as_text = f"concat(\"'\", {path}, \"': \", CASE t.k WHEN {NUMBER_TEXT} THEN 'numeric value' ELSE 'boolean' END, \" stored as string ('\", {shown}, \"')\")"
    mixed, kept = "s.n > 1 AND bit_count(s.mask) > 1", "(s.n = -1 OR s.n > 1)"
    mixed_text = f"concat(\"'\", s.path, \"': mixed types in array (\", {_NAMES}, ')')"
    added = lambda text: f"concat(s.issues, array(named_struct('no', s.made, 'text', {text})))"
    cases = [
        (_OPENS, {"n": _KIND, "mask": "0", "path": f"CASE WHEN s.n >= 0 THEN concat(s.path, '[', s.n, ']') WHEN s.n = -1 THEN {path} ELSE '' END",
                  "done": "0", "passed": "0D", "stack": f"concat(s.stack, array({_struct(counted)}))"}),
        (_ENDS, {"n": _top("n"), "mask": _top("mask"), "path": _top("path"), "stack": _POPPED,
                 "done": f"{_top('done')} + CASE WHEN s.n = -1 THEN s.done WHEN s.n > 1 THEN s.done + 1 ELSE 0 END",
                 "passed": f"{_top('passed')} + CASE WHEN s.n = -1 THEN s.passed WHEN {mixed} THEN s.passed + 0.5D WHEN s.n > 1 THEN s.passed + 1D ELSE 0D END",
                 "made": f"s.made + CASE WHEN {mixed} THEN 1 ELSE 0 END", "issues": f"CASE WHEN {mixed} THEN {added(mixed_text)} ELSE s.issues END",
                 "dropped": f"CASE WHEN NOT {kept} AND s.made > {_top('made')} THEN concat(s.dropped, array(named_struct('a', {_top('made')}, 'b', s.made))) ELSE s.dropped END"}),
        (half, counted | {"passed": "s.passed + 0.5D", "made": "s.made + 1", "issues": added(as_text)}),
        ("", counted),
    ]
    found = _scan(tokens_, state, given, cases, ("done", "passed"))
    every = "flatten(transform(f, x -> x.issues))"
    whole = "flatten(transform(f, x -> x.dropped))"
    left = (f"CASE WHEN exists(f, x -> size(x.dropped) > 0) THEN get(transform(array({whole}), d -> "
            f"filter({every}, i -> NOT exists(d, r -> i.no >= r.a AND i.no < r.b))), 0) ELSE {every} END")
    return F.expr(f"get(transform(array({found}), f -> named_struct('done', element_at(f, -1).done, 'passed', element_at(f, -1).passed, "
                  f"'issues', transform({left}, i -> i.text))), 0)")
