"""Finding many literals in many texts with equi-joins.

A literal match is a substring match: "Park" occurs in "parking". Comparing each
text with each literal does not scale, so both sides are cut at single spaces
and meet on a short key:

* a literal of two or more pieces: the end of its first piece and the start of
  its second one, because in the text the first may only have more characters on
  the left and the second (if last) only on the right;
* a literal of one piece: its leading characters, which the text offers for
  every position of a piece.

Key lengths follow the literals (short pieces give short keys), so no literal is
missed. Two phases where the texts are read: a Bloom filter of the literals' keys
(``sieve``) is tested for every key a text offers, and only what passes becomes a
row with the context that verifies the whole literal. So a long literal widens the
few rows that its key may meet and no others; texts are never shuffled and never
joined back.

Many literals may share a key ("the grey" begins a fact of every fifth matter), so
a key does not meet literals but the lengths they have: each length cuts one piece
out of the context, and pieces meet literals as a whole. A place in a text costs as
many rows as its key has lengths, however many literals the dictionary holds.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspan.functions import spans as S
from veilspan.functions.spans import unnest
from veilspan.operators.sieve import sieve
from veilspan.session import cut_lineage

KEY_CHARS = 4
GRAM_CHARS = 6


BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 32_000_000


def within_bound(table: DataFrame, rows: int, value_bytes: int) -> DataFrame:
    """Broadcast hint for a counted table under the bound; beyond it the join shuffles on its key."""
    return F.broadcast(table) if rows <= BROADCAST_ROWS and value_bytes <= BROADCAST_BYTES else apart(table, rows, value_bytes)


def apart(table: DataFrame, rows: int, value_bytes: int) -> DataFrame:
    """Of a counted table over the bound no task and no driver holds the whole: the join is told to shuffle, as what is guessed
    of the size of rendered or exploded rows may be far too small. A smaller one is left to the session's threshold."""
    return table if rows <= BROADCAST_ROWS and value_bytes <= BROADCAST_BYTES else table.hint("shuffle_merge")


def _folded(value: Column, ignore_case: bool) -> Column:
    return F.lower(value) if ignore_case else value


def _keyed_literals(literals: DataFrame, value: str, ignore_case: bool) -> DataFrame:
    """Literals with their profile (``a``, ``b``: key lengths; ``b`` is -1 for one piece) and key."""
    folded = literals.where(F.col(value) != "").withColumn("needle", _folded(F.col(value), ignore_case))
    pieces = F.split("needle", " ", -1)
    many = F.size(pieces) > 1
    cut = folded.select(
        "*",
        F.size(pieces).alias("n_pieces"),
        F.element_at(pieces, 1).alias("p1"),
        F.when(many, F.element_at(pieces, F.when(many, 2).otherwise(1))).alias("p2"),
    )
    sized = cut.select(
        "*",
        F.when(F.col("p2").isNull(), F.least(F.lit(GRAM_CHARS), F.length("p1"))).otherwise(F.least(F.lit(KEY_CHARS), F.length("p1"))).alias("a"),
        F.when(F.col("p2").isNull(), F.lit(-1)).otherwise(F.least(F.lit(KEY_CHARS), F.length("p2"))).alias("b"),
    )
    key = F.when(F.col("b") < 0, F.left("p1", F.col("a"))).otherwise(
        F.concat_ws(" ", F.right("p1", F.col("a")), F.left("p2", F.col("b")))
    )
    return sized.select("*", F.xxhash64("a", "b", key).alias("key")).drop("p2")


def literal_matches(
    texts: DataFrame,
    text_key: str,
    literals: DataFrame,
    value: str,
    ignore_case: bool = True,
    text: str = "text",
    scope: list[str] | None = None,
) -> DataFrame:
    """One row per occurrence: ``text_key``, all columns of ``literals``, ``start, end, found``.

    Overlapping occurrences are all reported. ``literals`` should hold each
    literal once (first owner kept) so that a hot literal adds no extra rows.
    ``scope`` columns, held by both sides, must be equal as well.
    """
    scope = scope or []
    keyed = cut_lineage(_keyed_literals(literals, value, ignore_case), "keyed-literals")  # counted here, joined below
    # at most (KEY_CHARS + 1)^2 + GRAM_CHARS rows, whatever the dictionary size
    shapes = keyed.groupBy("a", "b").agg(
        F.max("n_pieces").alias("reach"), F.count("*").alias("rows"), F.sum(F.octet_length(value)).alias("bytes")
    ).collect()
    kept = literals.columns
    mine = [text_key, *scope]
    if not shapes:
        empty = texts.select(text_key).where(F.lit(False))
        columns = [F.lit(None).cast(literals.schema[c].dataType).alias(c) for c in kept]
        return empty.select(text_key, *columns, F.lit(0).alias("start"), F.lit(0).alias("end"), F.lit("").alias("found"))
    total, held = sum(r["rows"] for r in shapes), sum(r["bytes"] for r in shapes)
    offered = offered_keys(texts, mine, text, ignore_case, shapes, sieve(keyed, "key", total))
    whole = keyed.withColumn("_whole", _whole(F.col("needle"), F.length(value))).drop("key", "a", "b", "p1", "n_pieces")
    cut = pieces_of_lengths(offered, mine, lengths_of(keyed, value, scope), scope, ignore_case, sieve(whole, "_whole", total))
    met = cut.join(within_bound(whole, total, held), ["_whole", *scope])
    verified = met.where((_folded(F.col("_found"), ignore_case) == F.col("needle")) & (F.col("_size") == F.length(value)))
    return verified.select(text_key, *kept, F.col("_from").alias("start"), (F.col("_from") + F.col("_size")).alias("end"), F.col("_found").alias("found"))


def _whole(folded: Column, size: Column) -> Column:
    return F.xxhash64(folded, size)


def lengths_of(keyed: DataFrame, value: str, scope: list[str]) -> DataFrame:
    """``key, scope..., lengths``: the different lengths of a key's literals, each with the length of the first piece."""
    lead = F.when(F.col("b") < 0, F.lit(0)).otherwise(F.length("p1"))
    each = keyed.select("key", *scope, lead.alias("lead"), F.length(value).alias("size")).distinct()
    told = each.groupBy("key", *scope).agg(F.collect_list(F.struct("lead", "size")).alias("lengths"))  # at most as many as the longest literal has characters, squared
    rows = each.count()
    return within_bound(told, rows, 16 * rows)


def pieces_of_lengths(offered: DataFrame, mine: list[str], lengths: DataFrame, scope: list[str], ignore_case: bool, passes) -> DataFrame:
    """``mine, _from, _size, _found, _whole``: what stands at an offered place, once for each length its key has, if ``passes`` lets it through."""
    def piece(length: Column) -> Column:
        skip = F.when(F.col("skip") >= 0, F.col("skip")).otherwise(F.length("piece") - length["lead"])
        return S.bind(F.col("context").substr(skip + 1, length["size"]), lambda found: F.struct(
            (F.col("at") + skip).alias("_from"), length["size"].alias("_size"), found.alias("_found"), _whole(_folded(found, ignore_case), length["size"]).alias("_whole"), (skip >= 0).alias("inside"),
        ))

    cut = unnest(offered.join(lengths, ["key", *scope]), F.transform("lengths", piece), "c", *mine)
    return cut.where(F.col("c.inside") & passes(F.col("c._whole"))).select(*mine, "c._from", "c._size", "c._found", "c._whole")


#: Up to this many pieces a place is told from the text itself, which is cheaper than sums over all pieces.
FEW_PIECES = 256


def offered_keys(texts: DataFrame, mine: list[str], text: str, ignore_case: bool, shapes: list, passes) -> DataFrame:
    """``mine, at, piece, context, key, skip`` for the keys that texts offer and that ``passes`` lets through.

    Pieces and the places in them are taken one by one in generated code, where nearly all drop out; arrays are built for what is left.
    """
    reach = max(r["reach"] for r in shapes)
    pairs = sorted((r["a"], r["b"]) for r in shapes if r["b"] >= 0)
    singles = sorted(r["a"] for r in shapes if r["b"] < 0)

    def starts_of(held: Column) -> Column:
        return S.bind(S.running(F.transform(held, lambda p: F.length(p) + 1)), lambda ends: F.zip_with(held, ends, lambda p, end: end - F.length(p) - 1))

    cut = texts.select(*mine, F.col(text).alias("_whole_text"), F.split(text, " ", -1).alias("_held"))
    # place 0 of a piece stands for the pair it makes with the next one, the others for the literals that may begin there
    placed = cut.select("*", F.when(F.size("_held") > FEW_PIECES, starts_of(F.col("_held"))).alias("_starts")).select("*", F.posexplode("_held").alias("_i", "piece"))
    last = F.greatest(F.lit(0), F.length("piece") - (singles[0] - 1)) if singles else F.lit(0)
    offered = placed.select("*", F.explode(F.sequence(F.lit(0), last)).alias("_j"))
    piece, after = _folded(F.col("piece"), ignore_case), _folded(F.get("_held", F.col("_i") + 1), ignore_case)
    keys = []
    for a, b in pairs:
        fits = (F.col("_j") == 0) & after.isNotNull() & (F.length(piece) >= a) & (F.length(after) >= b)
        keys.append((fits, F.xxhash64(F.lit(a), F.lit(b), F.concat_ws(" ", F.right(piece, F.lit(a)), F.left(after, F.lit(b))))))
    for a in singles:
        keys.append(((F.col("_j") > 0) & (F.length(piece) - F.col("_j") + 1 >= a), F.xxhash64(F.lit(a), F.lit(-1), F.substr(piece, F.col("_j"), F.lit(a)))))
    kept = offered.where(reduce(Column.__or__, [fits & passes(key) for fits, key in keys]))
    met = F.filter(F.array(*[F.when(fits, key) for fits, key in keys]), lambda k: k.isNotNull() & passes(k))
    at = F.when(F.col("_starts").isNotNull(), F.get("_starts", F.col("_i"))).when(F.col("_i") == 0, 0).otherwise(F.length(F.call_function("substring_index", F.col("_whole_text"), F.lit(" "), F.col("_i"))) + 1)
    context = F.array_join(F.slice("_held", F.col("_i") + 1, F.lit(reach)), " ")
    return unnest(kept, met, "key", *mine, at.alias("at"), "piece", context.alias("context"), (F.col("_j") - 1).alias("skip")).select(*mine, "at", "piece", "context", "key", "skip")


def containing(texts: DataFrame, text_key: str, literals: DataFrame, value: str, ignore_case: bool = True) -> DataFrame:
    """``text_key`` x literal pairs where the literal occurs at least once."""
    hits = literal_matches(texts, text_key, literals, value, ignore_case)
    return hits.select(text_key, *literals.columns).distinct()
