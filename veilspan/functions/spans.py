"""Span algebra on arrays of offsets, as Column expressions.

A span is ``struct<start, end, kind, ...>`` with half-open code-point offsets.
All work is per row, so a document never leaves its partition.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from veilspan.functions import patterns as P


def _empty(ddl: str) -> Column:
    return F.from_json(F.lit("[]"), f"array<{ddl}>")


#: Up to this many elements a plain fold is cheaper than sorting and doubling; both give the same.
FEW = 32


def _rounds(values: Column) -> Column:
    """0, 1, ..: as many doublings as cover an array."""
    return F.when(F.size(values) > 1, F.sequence(F.lit(0), F.ceil(F.log2(F.size(values))).cast("int") - 1)).otherwise(_empty("int"))


def _doubled(values: Column, joined: Callable[[Column, Column], Column]) -> Column:
    """Each element joined with all before it. A round reaches twice as far, so n elements take log n rounds and nothing is
    appended element by element."""
    return bind(values, lambda held: F.aggregate(
        _rounds(held), held, lambda acc, k: F.transform(acc, lambda v, i: joined(v, F.get(acc, i - F.call_function("shiftleft", F.lit(1), k)))),
    ))


def running(sizes: Column) -> Column:
    """Running sums of an int array, the element itself included."""
    return _doubled(sizes, lambda v, before: v + F.coalesce(before, F.lit(0)))


def running_max(values: Column) -> Column:
    """The greatest so far, the element itself included."""
    return _doubled(values, F.greatest)


#: Stands between pieces of a cut text. One in a text is read as ``STAND_IN``, which no pattern here tells from it.
MARK, STAND_IN = "\u0001", "\u0002"


def marked(text: Column, pattern: str, replacement: str) -> Column:
    return F.regexp_replace(F.replace(text, F.lit(MARK), F.lit(STAND_IN)), pattern, replacement)


def cut_at(text: Column, pattern: str, replacement: str) -> Column:
    """Pieces of the text between the marks that ``replacement`` sets at each match.

    A split by the pattern itself would compile it for every row.
    """
    return F.split(marked(text, pattern, replacement), MARK, -1)


def may_hold(text: Column, hints: tuple[str, ...]) -> Column:
    """Whether one of the (lower-case) literals occurs in the text, whatever its case."""
    def one(hint: str) -> Column:
        return (F.lower(text) if hint != hint.upper() else text).contains(hint)

    found = one(hints[0])
    for hint in hints[1:]:
        found = found | one(hint)
    return found


def scan(text: Column, pattern: str, make: Callable[[Column, Column, Column], Column], ddl: str, hints: tuple[str, ...] = ()) -> Column:
    """``make(start, match, gap)`` for every match, left to right.

    ``hints`` are lower-case literals of which every match holds one; those of the fixed patterns are known.

    The text is cut into gaps and matches, which take turns; running sums of their lengths give the
    offsets. Each row pays for one regex pass.
    """

    def walked(pieces: Column) -> Column:
        turns = F.sequence(F.lit(1), F.size(pieces) - 1, F.lit(2))
        pairs = F.transform(turns, lambda i: F.struct(
            F.get(pieces, i - 1).alias("gap"), F.get(pieces, i).alias("match"), (F.length(F.get(pieces, i - 1)) + F.length(F.get(pieces, i))).alias("size")
        ))
        return bind(pairs, lambda held: F.zip_with(
            held, running(F.transform(held, lambda p: p["size"])), lambda p, end: make(end - F.length(p["match"]), p["match"], p["gap"]).cast(ddl)
        ))

    # a text without a match is neither cut nor, where the pattern names a part that it must hold, searched
    found = bind(marked(text, pattern, f"{MARK}$0{MARK}"), lambda held: F.when(held.contains(MARK), bind(F.split(held, MARK, -1), walked)).otherwise(_empty(ddl)))
    hints = hints or P.HINTS.get(pattern)
    return F.when(may_hold(text, hints), found).otherwise(_empty(ddl)) if hints else found


def unnest(df, array: Column | str, name: str, *keep, at: str | None = None):
    """One row per non-null element, elements under ``name`` and, if asked for, their place under ``at``.

    Unlike a plain explode this does not invite the optimizer to filter on the
    array first, which would compute it twice.
    """
    rows = F.explode_outer(array).alias(name) if at is None else F.posexplode_outer(array).alias(at, name)
    return df.select(*keep, rows).where(F.col(name).isNotNull())


def computed(df, value: Column, name: str):
    """Add a column that is computed once per row, whatever filters and projections follow.

    A plain column that a later filter tests would be computed for the filter
    and again for the output.
    """
    return df.select("*", F.explode_outer(F.array(value)).alias(name))


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once and held as a lambda variable."""
    return F.element_at(F.transform(F.array(value), use), 1)


SPAN_DDL = "struct<start:int,end:int,kind:string>"


def span(start: Column, end: Column, kind: Column | str) -> Column:
    kind = F.lit(kind) if isinstance(kind, str) else kind
    return F.struct(start.alias("start"), end.alias("end"), kind.alias("kind"))


def regex_spans(text: Column, pattern: str, kind: str) -> Column:
    return scan(text, pattern, lambda at, match, gap: span(at, at + F.length(match), kind), SPAN_DDL)


def occurrence_starts(text: Column, needle: Column) -> Column:
    """0-based starts of every occurrence of a literal, overlapping ones included."""
    quoted = F.concat(F.lit(r"(?=\Q"), F.replace(needle, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E)"))
    pieces = F.split(text, quoted, -1)
    inner = bind(pieces, lambda held: running(F.transform(F.slice(held, F.lit(1), F.size(held) - 1), lambda p: F.length(p))))
    head = F.when(text.startswith(needle), F.array(F.lit(0))).otherwise(_empty("int"))
    return F.when((needle != "") & text.contains(needle), F.concat(head, inner)).otherwise(_empty("int"))


def literal_spans(text: Column, needle: Column, kind: Column | str) -> Column:
    return F.transform(occurrence_starts(text, needle), lambda at: span(at, at + F.length(needle), kind))


def islands(ordered: Column, touching: bool = False) -> Column:
    """Spans sorted by start, as one array for each stretch of text that they cover without a gap (``touching``: nor a seam)."""

    def cut(held: Column) -> Column:
        def heads_of(reach: Column) -> Column:
            def opens(at: Column) -> Column:
                start, before = F.get(held, at)["start"], F.get(reach, at - 1)
                return (at == 0) | (start > before if touching else start >= before)

            return F.filter(F.sequence(F.lit(0), F.size(held) - 1), opens)

        heads = bind(running_max(F.transform(held, lambda c: c["end"])), heads_of)
        return bind(heads, lambda at: F.transform(at, lambda h, j: F.slice(held, h + 1, F.coalesce(F.get(at, j + 1), F.size(held)) - h)))

    return bind(ordered, lambda held: F.when(F.size(held) > 1, cut(held)).otherwise(F.transform(held, lambda c: F.array(c))))


def _by_island(ordered: Column, chosen: Callable[[Column], Column], alone: Callable[[Column], Column]) -> Column:
    """``chosen`` of every island, ``alone`` of a span that overlaps no other; spans of different islands never meet."""
    return F.flatten(F.transform(islands(ordered), lambda g: F.when(F.size(g) == 1, F.transform(g, alone)).otherwise(chosen(g))))


def resolve_by_priority(candidates: Column) -> Column:
    """Most specific kind wins an overlap, then the longer span; result sorted by start.

    ``candidates`` hold ``start, end, kind`` in listing order. The choice is made inside each island; the matches of one pattern never
    overlap, so an island has few spans, however many the text has.
    """
    ranks = F.array(*[F.lit(k) for k in P.KIND_PRIORITY])
    keyed = F.transform(
        candidates,
        lambda c, i: F.struct(c["start"].alias("start"), c["end"].alias("end"), i.alias("listed"), F.array_position(ranks, c["kind"]).alias("rank"), c["kind"].alias("kind")),
    )

    def chosen(island: Column) -> Column:
        by_rank = F.array_sort(F.transform(island, lambda c: F.struct(
            c["rank"].alias("rank"), (c["start"] - c["end"]).alias("shorter"), c["listed"].alias("listed"), c["start"].alias("start"), c["end"].alias("end"), c["kind"].alias("kind")
        )))
        return F.array_sort(F.aggregate(by_rank, _empty(SPAN_DDL), lambda acc, c: F.when(
            F.exists(acc, lambda a: (c["start"] < a["end"]) & (c["end"] > a["start"])), acc
        ).otherwise(F.concat(acc, F.array(span(c["start"], c["end"], c["kind"]))))))

    return _by_island(F.array_sort(keyed), chosen, lambda c: span(c["start"], c["end"], c["kind"]))


ENTITY_DDL = "struct<start:int,end:int,kind:string,entity:string>"


def _first_from(starts: Column, at: Column) -> Column:
    """How many of the sorted ``starts`` lie before ``at``, by halving."""
    zero = F.struct(F.lit(0).alias("low"), F.size(starts).alias("high"))

    def step(acc: Column, _: Column) -> Column:
        middle = F.call_function("shiftright", acc["low"] + acc["high"], F.lit(1))
        right = F.get(starts, middle) < at
        return F.when(acc["low"] < acc["high"], F.struct(
            F.when(right, middle + 1).otherwise(acc["low"]).alias("low"), F.when(right, acc["high"]).otherwise(middle).alias("high")
        )).otherwise(acc)

    return F.aggregate(F.sequence(F.lit(0), F.ceil(F.log2(F.size(starts))).cast("int")), zero, step, lambda acc: acc["low"])


def chain(ordered: Column) -> Column:
    """Places of the spans that are met by going on from the first to the next one that begins at its end or later, and so forth.

    ``ordered`` are sorted by start. Every span points to its successor, found by halving; pointers are doubled log n times,
    and the chain doubles with each of them, the farthest jump first. Nothing is appended span by span.
    """

    def walked(starts: Column, held: Column) -> Column:
        n = F.size(held)
        after = F.transform(held, lambda c: _first_from(starts, c["end"]))
        jumps = F.aggregate(_rounds(held), F.array(after), lambda acc, _: F.concat(acc, F.array(bind(
            F.element_at(acc, -1), lambda last: F.transform(last, lambda j: F.coalesce(F.get(last, j), n))
        ))))
        return F.array_sort(F.aggregate(F.reverse(jumps), F.array(F.lit(0)), lambda met, jump: F.concat(
            met, F.filter(F.transform(met, lambda i: F.get(jump, i)), lambda j: j < n)
        )))

    return bind(ordered, lambda held: F.when(F.size(held) > 0, bind(F.transform(held, lambda c: c["start"]), lambda starts: walked(starts, held))).otherwise(_empty("int")))


def merge_leftmost_longest(candidates: Column) -> Column:
    """Leftmost, then longest, then a specific kind before a quasi identifier."""
    keyed = F.transform(
        candidates,
        lambda c, i: F.struct(
            c["start"].alias("start"),
            (c["start"] - c["end"]).alias("shorter"),
            (c["kind"] == "quasi_identifier").alias("vague"),
            i.alias("listed"),
            c["end"].alias("end"),
            c["kind"].alias("kind"),
            c["entity"].alias("entity"),
        ),
    )

    def plain(c: Column) -> Column:
        return F.struct(c["start"].alias("start"), c["end"].alias("end"), c["kind"].alias("kind"), c["entity"].alias("entity"))

    def folded(spans: Column) -> Column:
        return F.aggregate(
            spans,
            F.struct(F.lit(-1).alias("last"), _empty(ENTITY_DDL).alias("out")),
            lambda acc, c: F.when(c["start"] >= acc["last"], F.struct(c["end"].alias("last"), F.concat(acc["out"], F.array(plain(c))).alias("out"))).otherwise(acc),
            lambda acc: acc["out"],
        )

    return bind(F.array_sort(keyed), lambda spans: F.when(F.size(spans) <= FEW, folded(spans)).otherwise(
        F.transform(chain(spans), lambda i: plain(F.get(spans, i)))
    ))


def merge_overlapping(candidates: Column) -> Column:
    """Union of overlapping spans (touching ones stay apart); the earliest one names the kind.

    ``candidates`` hold ``start, end, listed, kind``; ``listed`` is the detector's place.
    """
    ordered = F.array_sort(
        F.transform(
            candidates,
            lambda c: F.struct(c["start"].alias("start"), c["end"].alias("end"), c["listed"].alias("listed"), c["kind"].alias("kind")),
        )
    )
    return F.transform(islands(ordered), lambda g: span(F.get(g, F.lit(0))["start"], F.array_max(F.transform(g, lambda c: c["end"])), F.get(g, F.lit(0))["kind"]))


def cover(intervals: Column) -> Column:
    """Disjoint union of ``start, end`` intervals, touching ones joined."""
    ordered = F.array_sort(F.transform(intervals, lambda c: F.struct(c["start"].alias("start"), c["end"].alias("end"))))
    return F.transform(islands(ordered, touching=True), lambda g: F.struct(
        F.get(g, F.lit(0))["start"].alias("start"), F.array_max(F.transform(g, lambda c: c["end"])).alias("end")
    ))


def covered_chars(disjoint: Column, start: Column, end: Column) -> Column:
    """How many characters of [start, end) lie inside disjoint intervals."""
    return F.aggregate(
        disjoint,
        F.lit(0),
        lambda acc, c: acc + F.greatest(F.lit(0), F.least(c["end"], end) - F.greatest(c["start"], start)),
    )


def placeholder_base(kind: Column) -> Column:
    return F.when(kind == "judge_flag", F.lit("QUASI_IDENTIFIER")).otherwise(F.upper(kind))


REDACTED_DDL = "struct<start:int,end:int,kind:string,replacement:string>"


def assign_placeholders(spans: Column, base: Callable[[Column], Column] | None = None) -> Column:
    """Typed placeholders: one per entity, numbered only when a kind has several.

    ``spans`` are disjoint, sorted ``start, end, kind, entity``. An entity seen
    under two bases takes the base that appears later in the document.
    ``base`` maps a span to its placeholder base.
    """
    base = base or (lambda s: placeholder_base(s["kind"]))
    return bind(spans, lambda held: F.when(F.size(held) <= FEW, _placed_by_search(held, base)).otherwise(_placed_by_sorting(held, base)))


def _placed(s: Column, replacement: Column) -> Column:
    return F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"), replacement.alias("replacement"))


def _numbered(base: Column, peers: Column, number: Column) -> Column:
    return F.when(peers == 1, F.concat(F.lit("["), base, F.lit("]"))).otherwise(F.concat(F.lit("["), base, F.lit("_"), number.cast("string"), F.lit("]")))


def _placed_by_search(spans: Column, base: Callable[[Column], Column]) -> Column:
    """Each span looks its entity up among all: few spans."""
    pairs = F.array_distinct(F.transform(spans, lambda s: F.struct(base(s).alias("base"), s["entity"].alias("entity"))))
    # (pairs, bases) ride along in a one-element array so that both are computed once per row
    frame = bind(pairs, lambda p: F.struct(p.alias("pairs"), F.array_distinct(F.transform(p, lambda x: x["base"])).alias("bases")))

    def label(f: Column, s: Column) -> Column:
        own = F.array_max(
            F.transform(
                F.filter(f["pairs"], lambda p: p["entity"] == s["entity"]),
                lambda p: F.struct(F.array_position(f["bases"], p["base"]).alias("at"), p["base"].alias("base")),
            )
        )["base"]
        peers = F.transform(F.filter(f["pairs"], lambda p: p["base"] == own), lambda p: p["entity"])
        return _numbered(own, F.size(peers), F.array_position(peers, s["entity"]))

    return bind(frame, lambda f: F.transform(spans, lambda s: _placed(s, label(f, s))))


def _ranked(ordered: Column, value: Callable[[Column], Column]) -> Column:
    """For a sorted array, how many different values came before each element's own."""
    return running(F.transform(ordered, lambda x, i: F.when((i > 0) & (value(x) != value(F.get(ordered, i - 1))), 1).otherwise(0)))


def _placed_by_sorting(spans: Column, base: Callable[[Column], Column]) -> Column:
    """The same by sorting and running counts; ``told`` are the spans as text of base and entity, equal ones kept once."""
    mark = F.lit("\u0000")
    told = F.array_distinct(F.transform(spans, lambda s: F.concat(base(s), mark, s["entity"])))
    split = F.transform(told, lambda t, k: F.struct(F.substring_index(t, "\u0000", 1).alias("base"), t.alias("told"), k.alias("at")))

    def places(pairs: Column, bases: Column) -> Column:
        # number of each pair among the pairs of its base, in order of appearance
        by_base = F.array_sort(F.transform(pairs, lambda p: F.struct(F.array_position(bases, p["base"]).alias("nth"), p["at"].alias("at"), p["base"].alias("base"), p["told"].alias("told"))))
        sizes = F.transform(bases, lambda b: F.size(F.filter(pairs, lambda p: p["base"] == b)))

        def labelled(ordered: Column, counts: Column, before: Column) -> Column:
            return F.transform(ordered, lambda p, i: F.struct(
                p["told"].substr(F.length(p["base"]) + 2, F.length(p["told"])).alias("entity"), (-p["nth"]).alias("nth"),
                _numbered(p["base"], F.get(counts, (p["nth"] - 1).cast("int")), i + 1 - F.get(before, (p["nth"] - 1).cast("int")) + F.get(counts, (p["nth"] - 1).cast("int"))).alias("label"),
            ))

        # the entity's pair under the base that appears last stands first among its own
        return F.array_sort(bind(by_base, lambda o: bind(sizes, lambda c: bind(running(c), lambda r: labelled(o, c, r)))))

    pairs = bind(split, lambda p: bind(F.array_distinct(F.transform(p, lambda x: x["base"])), lambda b: places(p, b)))
    labels = bind(pairs, lambda o: F.transform(F.filter(o, lambda x, i: (i == 0) | (x["entity"] != F.get(o, i - 1)["entity"])), lambda x: x["label"]))
    by_entity = F.array_sort(F.transform(spans, lambda s, i: F.struct(s["entity"].alias("entity"), i.alias("at"))))
    found = bind(labels, lambda names: bind(by_entity, lambda o: F.zip_with(o, _ranked(o, lambda x: x["entity"]), lambda x, k: F.struct(x["at"].alias("at"), F.get(names, k).alias("label")))))
    return F.zip_with(spans, F.array_sort(found), lambda s, x: _placed(s, x["label"]))


BLOCK = 1024


def parts_of(text: Column, use: Callable[[Callable[[Column, Column], Column]], Column]) -> Column:
    """``use(part)`` where ``part(start, size)`` cuts a piece out of the text; a long text is cut into blocks once, so that a
    piece costs its own length and not its place."""

    def blocked(blocks: Column) -> Column:
        def part(start: Column, size: Column) -> Column:
            first = F.call_function("shiftright", start, F.lit(10))
            near = F.array_join(F.slice(blocks, first + 1, F.call_function("shiftright", start + size, F.lit(10)) - first + 1), "")
            return near.substr(start - F.call_function("shiftleft", first, F.lit(10)) + 1, size)

        return use(part)

    def plain(start: Column, size: Column) -> Column:
        return text.substr(start + 1, size)

    return F.when(F.length(text) <= 4 * BLOCK, use(plain)).otherwise(bind(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0)), blocked))


def replace_spans(text: Column, spans: Column) -> Column:
    """Text with each ``start, end, replacement`` span swapped for its replacement."""

    def swapped(part: Callable[[Column, Column], Column]) -> Column:
        def pieces(held: Column) -> Column:
            def one(s: Column, i: Column) -> Column:
                begin = F.coalesce(F.get(held, i - 1)["end"], F.lit(0))
                return F.concat(part(begin, s["start"] - begin), s["replacement"])

            end = F.element_at(held, -1)["end"]
            return F.concat(F.array_join(F.transform(held, one), ""), part(end, F.length(text) - end))

        return bind(spans, pieces)

    return F.when(F.size(spans) > 0, parts_of(text, swapped)).otherwise(text)


def to_original(spans: Column, start: Column, end: Column) -> Column:
    """Range of the redacted text as a range of the original, widened to whole placeholders."""
    none = F.lit(None).cast("int")

    def step(acc: Column, s: Column) -> Column:
        at = s["start"] + acc["shift"]
        stop = at + F.length(s["replacement"])
        first = F.coalesce(
            acc["first"], F.when(start < at, start - acc["shift"]).when(start < stop, s["start"])
        )
        last = F.coalesce(acc["last"], F.when(end <= at, end - acc["shift"]).when(end <= stop, s["end"]))
        grown = acc["shift"] + F.length(s["replacement"]) - (s["end"] - s["start"])
        return F.struct(grown.alias("shift"), first.alias("first"), last.alias("last"))

    return F.aggregate(
        spans,
        F.struct(F.lit(0).alias("shift"), none.alias("first"), none.alias("last")),
        step,
        lambda acc: F.struct(
            F.coalesce(acc["first"], start - acc["shift"]).alias("start"),
            F.coalesce(acc["last"], end - acc["shift"]).alias("end"),
        ),
    )
