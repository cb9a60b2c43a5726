"""Column expressions over sequences, tiles, chains and mappings. All are native."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from strandloom.config import DEFAULT, AlignConfig

MAPPING = "struct<position:int,mismatches:array<struct<position:int,new_base:string>>,indels:array<struct<type:string,position:int,length:int>>>"


def bases(text: str = "text") -> Column:
    """A sequence over ACGT from any text: its letters, each to one of four bases."""
    letters = F.regexp_replace(F.lower(F.expr(text)), "[^a-z]", "")
    return F.translate(letters, "abcdefghijklmnopqrstuvwxyz", ("ACGT" * 7)[:26])


def ladder(length: Column, padding: int, config: AlignConfig = DEFAULT) -> Column:
    """Divisions to try for a read of this length, in order."""
    array = lambda xs: F.array(*[F.lit(x) for x in xs])
    return F.when(length - padding <= config.short_length, array(config.short_divisions)).otherwise(array(config.divisions))


def tiles(seq: Column, padding: Column, div: Column, config: AlignConfig = DEFAULT) -> Column:
    """The read cut into tiles: ``padding`` bases go with the first, and a last one that is too short joins the one
    before it. Reads shorter than the padding plus ``div`` have no tiles."""
    body = F.length(seq) - padding
    step = F.floor(body / div).cast("int")
    count = F.ceil(body / F.greatest(step, F.lit(1))).cast("int")
    start = lambda i: F.when(i == 0, F.lit(1)).otherwise(padding + i * step + 1)
    short = (body - (count - 1) * step < config.combine_length) & (count > 1)
    last = F.when(short, count - 2).otherwise(count - 1)
    piece = lambda i: F.substring(seq, start(i), F.when(i == last, F.length(seq)).otherwise(padding + (i + 1) * step) - start(i) + 1)
    return F.when(step >= 1, F.transform(F.sequence(F.lit(0), last), piece)).otherwise(F.array().cast("array<string>"))


def cut_tiles(seq: str, padding: int, div: int, config: AlignConfig = DEFAULT) -> list[str]:
    """The tiles of a read that a task holds, as ``tiles`` cuts them."""
    body = len(seq) - padding
    step = body // div
    if step < 1:
        return []
    count = -(-body // step)
    last = count - 2 if count > 1 and body - (count - 1) * step < config.combine_length else count - 1
    start = lambda i: padding + i * step if i else 0
    return [seq[start(i) : len(seq) if i == last else padding + (i + 1) * step] for i in range(last + 1)]


def chains(hits: Column, max_gap: int = DEFAULT.max_gap) -> Column:
    """All chains through the tiles' sorted hits: arrays with a position for each tile, -1 for a tile without hits.

    Each position lies behind the last one found, by ``max_gap`` at most; a tile with hits can't be left out.
    """
    state = "array<struct<chain:array<int>,last:int>>"
    fits = lambda a: lambda p: (a["last"] < 0) | ((p > a["last"]) & (p <= a["last"] + max_gap))
    grow = lambda a, s: F.when(F.size(s) == 0, F.array(F.struct(F.concat(a["chain"], F.array(F.lit(-1))).alias("chain"), a["last"].alias("last")))).otherwise(F.transform(F.filter(s, fits(a)), lambda p: F.struct(F.concat(a["chain"], F.array(p)).alias("chain"), p.alias("last"))))
    start = F.array(F.struct(F.array().cast("array<int>").alias("chain"), F.lit(-1).alias("last"))).cast(state)
    return F.transform(F.aggregate(hits, start, lambda acc, s: F.flatten(F.transform(acc, lambda a: grow(a, s))).cast(state)), lambda a: a["chain"])


def chain_count(hits: Column, max_gap: int = DEFAULT.max_gap) -> Column:
    """How many chains there are, without making any: the ways that lead to each place are summed up tile by tile."""
    state = "array<struct<last:int,n:bigint>>"
    fits = lambda p: lambda a: (a["last"] < 0) | ((p > a["last"]) & (p <= a["last"] + max_gap))
    total = lambda xs: F.aggregate(xs, F.lit(0).cast("bigint"), lambda n, a: n + a["n"])
    grow = lambda acc, s: F.when(F.size(s) == 0, acc).otherwise(F.filter(F.transform(s, lambda p: F.struct(p.alias("last"), total(F.filter(acc, fits(p))).alias("n"))), lambda a: a["n"] > 0))
    start = F.array(F.struct(F.lit(-1).alias("last"), F.lit(1).cast("bigint").alias("n"))).cast(state)
    return total(F.aggregate(hits, start, lambda acc, s: grow(acc, s).cast(state)))


def has_hit(chain: Column) -> Column:
    """Whether a chain has a found tile at all."""
    return F.exists(chain, lambda p: p >= 0)


#: Arrays of up to so many values are searched from the front.
SHORT = 32


def insertion_point(values: Column, value: Column) -> Column:
    """First place in an ascending array whose value isn't below ``value``; the array's size if there is none.

    A long array is halved again and again: as many steps as its size has bits. A null value has place 0, a null array none.
    """
    steps = F.sequence(F.lit(1), F.ceil(F.log2(F.size(values) + 1.0)).cast("int"))
    start = F.struct(F.lit(0).alias("low"), F.size(values).alias("high"))

    def halve(s: Column, _: Column) -> Column:
        middle = F.floor((s["low"] + s["high"]) / 2).cast("int")
        below = F.coalesce((s["low"] < s["high"]) & (F.try_element_at(values, middle + 1) < value), F.lit(False))
        low = F.when(below, middle + 1).otherwise(s["low"])
        high = F.when(below | (s["low"] >= s["high"]), s["high"]).otherwise(middle)
        return F.struct(low.alias("low"), high.alias("high"))

    halved = F.aggregate(steps, start, halve, lambda s: s["low"])
    return F.when(F.size(values) <= SHORT, F.size(F.filter(values, lambda x: x < value))).when(values.isNotNull(), halved)


def bases_from(ref: Column, place: Column, count: Column) -> Column:
    """``count`` bases of a reference from ``place`` on; a dot for each that lies before its front or behind its end."""
    front = F.greatest(F.lit(0), F.least(count, -place))
    inner = F.substring(ref, F.greatest(place, F.lit(0)) + 1, F.greatest(F.lit(0), count - front))
    return F.rpad(F.concat(F.repeat(F.lit("."), front), inner), count, F.lit("."))


def alignment_view(ref: Column, seq: Column, mapping: str = "mapping") -> Column:
    """struct<top, low>: the reference and the read as they are aligned, one letter for each column, gaps as '-'.

    One walk over the indels in order of place. What an insertion has beyond the read's end isn't drawn; an indel at a
    place that a deletion has passed is left out. Null inputs give null.
    """
    m, size = F.col(mapping), F.length(seq)
    state = "struct<i:int,j:int,top:string,low:string>"
    start = F.struct(m["position"].alias("i"), F.lit(0).alias("j"), F.lit("").alias("top"), F.lit("").alias("low")).cast(state)

    def along(s: Column, count: Column) -> Column:
        top = F.concat(s["top"], bases_from(ref, s["i"], count))
        return F.struct((s["i"] + count).alias("i"), (s["j"] + count).alias("j"), top.alias("top"), F.concat(s["low"], F.substring(seq, s["j"] + 1, count)).alias("low")).cast(state)

    def gap(s: Column, x: Column) -> Column:
        n, rest = x["length"], F.least(x["length"], size - s["j"])
        lost = F.struct((s["i"] + n).alias("i"), s["j"].alias("j"), F.concat(s["top"], bases_from(ref, s["i"], n)).alias("top"), F.concat(s["low"], F.repeat(F.lit("-"), n)).alias("low"))
        more = F.struct(s["i"].alias("i"), (s["j"] + rest).alias("j"), F.concat(s["top"], F.repeat(F.lit("-"), rest)).alias("top"), F.concat(s["low"], F.substring(seq, s["j"] + 1, rest)).alias("low"))
        return F.when(s["j"] >= size, s).when(x["type"] == "D", lost.cast(state)).otherwise(more.cast(state))

    def step(s: Column, x: Column) -> Column:
        # The walk goes on to the indel first; two nested folds of one element keep each state from being spelled out twice.
        on = F.transform(F.array(s), lambda t: along(t, F.least(x["position"] - t["i"], size - t["j"])))
        return F.when(x["position"] < s["i"], s).otherwise(F.element_at(F.transform(on, lambda t: gap(t, x)), 1))

    order = F.array_sort(m["indels"], lambda a, b: a["position"] - b["position"])
    last = F.aggregate(order, start, lambda s, x: step(s, x).cast(state))
    done = F.element_at(F.transform(F.array(last), lambda t: along(t, size - t["j"])), 1)
    return F.when(ref.isNotNull() & seq.isNotNull() & m.isNotNull(), F.struct(done["top"].alias("top"), done["low"].alias("low")))


def ungapped(line: Column) -> Column:
    """What a line of a view shows, without gaps: of the lower one the read, of the upper one its part of the reference."""
    return F.translate(line, "-.", "")


def merge_unmatched(chain: Column, parts: Column) -> Column:
    """Tiles of a chain with their positions, neighbouring tiles without position put together."""
    pair = "array<struct<position:int,tile:string>>"
    zipped = F.zip_with(chain, parts, lambda p, t: F.struct(p.cast("int").alias("position"), t.alias("tile")))
    join = lambda acc, x: F.when((F.size(acc) > 0) & (x["position"] < 0) & (F.element_at(acc, -1)["position"] < 0), F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(F.lit(-1).alias("position"), F.concat(F.element_at(acc, -1)["tile"], x["tile"]).alias("tile"))))).otherwise(F.concat(acc, F.array(x))).cast(pair)
    first = F.slice(zipped, 1, 1).cast(pair)
    return F.aggregate(F.slice(zipped, 2, F.greatest(F.size(zipped) - 1, F.lit(0))), first, join)


def num_errors(mapping: str = "mapping") -> Column:
    """Mismatches, and the lengths of all indels."""
    return F.size(F.col(mapping)["mismatches"]) + F.aggregate(F.col(mapping)["indels"], F.lit(0), lambda a, x: a + x["length"])


def mapping_text(mapping: str = "mapping") -> Column:
    """A mapping in one line: position, then mismatches as place and base, then indels as type, place and length."""
    m = F.col(mapping)
    wrong = F.transform(m["mismatches"], lambda x: F.concat(F.lit("S"), x["position"].cast("string"), F.lit(":"), x["new_base"]))
    gaps = F.transform(m["indels"], lambda x: F.concat(x["type"], x["position"].cast("string"), F.lit(":"), x["length"].cast("string")))
    return F.concat_ws(" ", m["position"].cast("string"), F.array_join(F.concat(wrong, gaps), ","))


def mutation_key(kind: Column, position: Column, new_base: Column) -> Column:
    """What makes two mutations the same: type, position and base, which a deletion doesn't have; for grouping and joins."""
    return F.struct(kind.alias("type"), position.alias("position"), F.when(kind != "D", new_base).alias("new_base"))


def same_mapping(a: Column, b: Column) -> Column:
    """Whether two mappings have the same position and the same mismatches and indels, in any order; nulls equal each other."""
    parts = lambda m: F.struct(m["position"], F.array_sort(m["mismatches"]), F.array_sort(m["indels"]))
    return F.when(a.isNull() | b.isNull(), a.isNull() & b.isNull()).otherwise(parts(a).eqNullSafe(parts(b)))


# How the parts of a mapping are written out in full.


def indel_form(x: Column) -> Column:
    return F.concat(F.lit("Indel{"), x["type"], F.lit("@"), x["position"].cast("string"), F.lit(", l="), x["length"].cast("string"), F.lit("}"))


def mutation_form(kind: Column, position: Column, new_base: Column) -> Column:
    """A mutation of type S (written M), I or D; a deletion has no base."""
    base = F.when(kind == "D", "").otherwise(F.concat(F.lit(", new="), new_base))
    return F.concat(F.lit("Mutation{"), F.when(kind == "S", "M").otherwise(kind), F.lit("@"), position.cast("string"), base, F.lit("}"))


def mapping_form(m: Column) -> Column:
    wrong = F.array_join(F.transform(m["mismatches"], lambda x: F.concat(x["new_base"], F.lit("@"), x["position"].cast("string"))), ", ")
    gaps = F.array_join(F.transform(m["indels"], indel_form), ", ")
    return F.concat(F.lit("Mapping{pos="), m["position"].cast("string"), F.lit(", mis={"), wrong, F.lit("}, indels={"), gaps, F.lit("}}"))


def read_form(seq: Column, m: Column) -> Column:
    return F.concat(F.lit("ReadSequence{read="), seq, F.lit(", mapping="), mapping_form(m), F.lit("}"))


def pair_form(left: Column, right: Column) -> Column:
    """Both mates' sequences; null if one is."""
    return F.concat(F.lit("ReadPair{left="), left, F.lit(", right="), right, F.lit("}"))


def length_adjust(mapping: str = "mapping") -> Column:
    """Deleted less inserted bases."""
    return F.aggregate(F.col(mapping)["indels"], F.lit(0), lambda a, x: a + F.when(x["type"] == "D", x["length"]).otherwise(-x["length"]))
