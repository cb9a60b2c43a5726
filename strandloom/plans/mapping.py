"""Whole mapping jobs: reads to mappings to mutations, and reads in mapped order.

References and reads are tables (ref_id, seq) and (ref_id, read_idx, pair_id, mate, label, seq): each read belongs to one
reference, so one job maps reads of many references at once. With one reference file all rows have the same ref_id.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import islice

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from strandloom.config import DEFAULT, AlignConfig
from strandloom.functions.sequence import MAPPING, cut_tiles, insertion_point, ladder, length_adjust, merge_unmatched, num_errors, tiles
from strandloom.operators.find import occurrences, seed_hits
from strandloom.operators.kernel import Chain, Task, Window, align_many, place_many
from strandloom.operators.pairs import select_pairs
from strandloom.operators.paths import paths
from strandloom.operators.pileup import active, depth, majority, mapping_order, mutation_lines, read_mutations
from strandloom.operators.references import PORTION, cut, in_parts, lengths, spread_join, windows
from strandloom.sources.shared import written
from strandloom.sources.text import mean_read_length, read_reads, reference_parts

READ = ["ref_id", "read_idx", "pair_id", "mate", "seq"]
#: Bases of windows that one call of the kernel works on, besides those of the group of reads at hand.
MOST_BASES = 1 << 20
#: Chains that one call of the kernel works on.
CHAINS = 2048
#: Attempts are numbered by padding and, within it, division.
PADDING = 10
#: With so many unmapped reads or fewer, all their other attempts make one round.
SMALL = 256
#: Whole references of so many bases or fewer go to their reads; longer ones are searched by blocks.
NEAR = 4096
#: Reads that one task gets together with their references, about.
READS = 32_768


@dataclass
class Summary:
    """What a mapping job counted on the way: rounds are (first attempt, last attempt, reads sought)."""

    reads: int = 0
    mapped: int = 0
    failed_pairs: int = 0
    bases: int = 0
    coverage: float = 0.0
    dropped_indels: int = 0
    rounds: list[tuple[int, int, int]] = field(default_factory=list)

    def lines(self, order: bool = False) -> list[str]:
        """What the command prints; of an ordering job only the share of mapped reads is known."""
        share = 100 * self.mapped / self.reads if self.reads else 0.0
        out = [f"mapped {self.mapped} of {self.reads} reads ({share:.2f} %)"]
        if not order:
            out += [f"mean coverage {self.coverage:.4f}", f"pairs left out as a read failed: {self.failed_pairs}", f"indel bases left out beside another indel: {self.dropped_indels}"]
        return out


def attempts(reads: DataFrame, paddings: range, config: AlignConfig = DEFAULT) -> DataFrame:
    """Reads that are long enough, once for each padding and division: attempt (their order), parts (the tiles).

    A null read has none; repeated rows are tried each.
    """
    rows = reads.filter(F.length("seq") > config.min_length).select(*READ, F.explode(F.array(*[F.lit(p) for p in paddings])).alias("padding"))
    rows = rows.select(*READ, "padding", F.posexplode(ladder(F.length("seq"), F.col("padding"), config)).alias("step", "div"))
    rows = rows.filter(F.length("seq") - F.col("padding") >= F.col("div"))  # others have no tiles; cheaper than cutting them first
    rows = rows.withColumn("parts", tiles(F.col("seq"), F.col("padding"), F.col("div"), config))
    return rows.select(*READ, (F.col("padding") * PADDING + F.col("step")).alias("attempt"), "parts")


def read_roots(tried: DataFrame, refs: DataFrame, config: AlignConfig = DEFAULT) -> DataFrame:
    """``tried`` with root, hits and merged, a row for each place of the first found tile: all chains that begin there.

    hits are the places of the found tiles as far as a chain from the root can reach; a root from which some found tile
    is out of reach has no chain. merged are the tiles, neighbours without a place put together, which are the same in
    all chains of an attempt (place 0: found). Chains themselves aren't made here: their number may grow with every tile.
    """
    each = tried.select("ref_id", "read_idx", "attempt", F.posexplode("parts").alias("tile", "pattern"))
    patterns = each.select("ref_id", F.struct("read_idx", "attempt", "tile").alias("pattern_id"), "pattern")
    hits = seed_hits(patterns, refs, by_ref=True)
    by_read = hits.groupBy("ref_id", "pattern_id.read_idx", "pattern_id.attempt").agg(F.sort_array(F.collect_list(F.struct(F.col("pattern_id.tile").alias("tile"), "hits"))).alias("found"))
    return rooted(tried.join(by_read, ["ref_id", "read_idx", "attempt"]), config)  # a read without any hit has no chain to use


def rooted(rows: DataFrame, config: AlignConfig = DEFAULT) -> DataFrame:
    """Attempts with found, the tiles that have a place and their sorted places, as ``read_roots`` gives them."""
    pattern = F.transform(F.sequence(F.lit(0), F.size("parts") - 1), lambda i: F.when(F.exists("found", lambda x: x["tile"] == i), 0).otherwise(-1))
    rows = rows.withColumn("merged", merge_unmatched(pattern, F.col("parts")))
    rows = rows.withColumn("root", F.explode(F.col("found")[0]["hits"]))
    reach = F.col("root") + config.max_gap * F.size("found")

    def near_hits(x: Column, i: Column) -> Column:
        """A tile's places within reach, found by halving: a tile may stand at very many places of a reference."""
        low, high = insertion_point(x["hits"], F.col("root") + 1), insertion_point(x["hits"], reach + 1)
        return F.when(i == 0, F.array("root")).otherwise(F.slice(x["hits"], low + 1, high - low))

    near = F.transform("found", near_hits)
    return rows.withColumn("hits", near).drop("found", "parts").filter(F.forall("hits", lambda h: F.size(h) > 0))


def place_chains(roots: DataFrame, refs: DataFrame, mean: int, config: AlignConfig = DEFAULT) -> DataFrame:
    """ref_id, read_idx, pair_id, mate, attempt, map_idx, mapping, failed: a row for each chain that gives a mapping in its
    read's first attempt that gives any; map_idx is their order.

    A root meets the block of its reference in which its window starts (see ``windows``), and only the window goes to
    Python. There the chains of an attempt are made one after the other, and attempts of a read are tried in order and no
    further than needed, those of all reads of an Arrow batch together. Where a chain can't be computed, its read goes no
    further and has a row with failed = true.
    """
    rows = windows(with_reach(roots, mean, config), refs, "start", "span", ["read_idx"])
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # small rows, much work: not to be coalesced
    return place_windows(rows.repartition(n, "read_idx"), mean, config)


def with_reach(roots: DataFrame, mean: int, config: AlignConfig = DEFAULT) -> DataFrame:
    """``roots`` with start and span, the place and length of the window that a root's chains can need."""
    back = F.length("seq") + 2 * mean
    rows = roots.withColumn("start", F.greatest(F.lit(0), F.col("root") - back))
    return rows.withColumn("span", config.max_gap * F.size("merged") + back + 2 * F.length("seq") + 2 * mean + 2)


def place_windows(rows: DataFrame, mean: int, config: AlignConfig = DEFAULT) -> DataFrame:
    """What ``place_chains`` gives, of roots that have their window; all rows of a read are in one partition."""
    keys = ["ref_id", "read_idx", "pair_id", "mate", "attempt"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state: dict = {}  # read: (attempt that mapped or None, failed, mappings); only the last read can go on in the next batch
        for f in frames:
            todo: dict = {}
            for at, (read, attempt) in enumerate(zip(f["read_idx"], f["attempt"])):
                todo.setdefault(read, {}).setdefault(attempt, []).append(at)
            state = {r: s for r, s in state.items() if r in todo}
            queues = {r: list(tries.items()) for r, tries in todo.items()}
            cols = {c: f[c].to_numpy() for c in ("merged", "hits", "window", "start", "seq")}

            def chains(wave: list, cols: dict = cols) -> Iterator[tuple]:
                for read, attempt, at in wave:
                    text, start = cols["window"][at], int(cols["start"][at])
                    # A window that ends early ends with its reference; otherwise nothing asks for what is behind it.
                    ref, tiles = Window(text, start, start + len(text)), [x["tile"] for x in cols["merged"][at]]
                    found = [k for k, x in enumerate(cols["merged"][at]) if x["position"] >= 0]
                    for path in paths([h.tolist() for h in cols["hits"][at]], config.max_gap):
                        places = [-1] * len(tiles)
                        for k, p in zip(found, path):
                            places[k] = p
                        yield read, attempt, at, Chain(ref, cols["seq"][at], places, tiles)

            while queues:
                wave = []
                for read in list(queues):
                    won, broken, _ = state.get(read, (None, False, 0))
                    attempt, where = queues[read].pop(0)
                    if broken or (won is not None and attempt != won):
                        del queues[read]
                        continue
                    wave += [(read, attempt, at) for at in where]
                    if not queues[read]:
                        del queues[read]
                lazy = chains(wave)
                while some := list(islice(lazy, CHAINS)):
                    out = []
                    for (read, attempt, at, _), (m, broken) in zip(some, place_many([c for *_, c in some], mean, config)):
                        won, was, n = state.get(read, (None, False, 0))
                        state[read] = (attempt if m is not None else won, was or broken, n + (m is not None))
                        if m is not None or broken:
                            out.append((at, n, m.row() if m is not None else None, broken))
                    if out:
                        at, n, mapping, broken = zip(*out)
                        yield f[keys].iloc[list(at)].assign(map_idx=n, mapping=list(mapping), failed=broken)

    rows = rows.select(*keys, "seq", "merged", "hits", "window", "start", "root")
    schema = ", ".join(f"{c} {t}" for c, t in rows.select(*keys).dtypes)
    rows = rows.sortWithinPartitions("read_idx", "attempt", "root")
    return rows.mapInPandas(run, f"{schema}, map_idx long, mapping {MAPPING}, failed boolean")


def map_round(tried: DataFrame, refs: DataFrame, mean: int, config: AlignConfig = DEFAULT) -> DataFrame:
    """All mappings of each read at its first attempt of ``tried`` that gives any (READ keys, map_idx, mapping), and rows with
    failed = true of reads for which computing one went wrong."""
    roots = written(read_roots(written(tried, "map-attempts"), refs, config), "map-roots")
    placed = written(place_chains(roots, refs, mean, config), "map-placed")
    return placed.select("ref_id", "read_idx", "pair_id", "mate", "mapping", "map_idx", "failed")


def near_references(reads: DataFrame, refs: DataFrame) -> tuple[DataFrame | None, DataFrame | None]:
    """The whole references of ``NEAR`` bases or fewer, with often, the number of their reads; and the others. None: no rows."""
    if in_parts(refs):
        return None, refs
    often = reads.groupBy("ref_id").agg(F.count(F.lit(1)).alias("often"))
    near = refs.filter(F.length("seq") <= NEAR).select("ref_id", F.col("seq").alias("text")).join(often, "ref_id")
    near, far = written(near, "map-near"), refs.filter(F.length("seq") > NEAR)
    return (None if near.isEmpty() else near), (None if far.isEmpty() else far)


def tries(seq: str, config: AlignConfig = DEFAULT) -> Iterator[tuple[int, list[str]]]:
    """(attempt, tiles) of a read that a task holds, one after the other: what ``attempts`` gives, in order."""
    for padding in range(config.max_padding + 1):
        divisions = config.short_divisions if len(seq) - padding <= config.short_length else config.divisions
        for step, div in enumerate(divisions):
            if len(seq) - padding >= div:
                yield padding * PADDING + step, cut_tiles(seq, padding, div, config)


def tile_chains(read: str, tiles: list[str], ref: Window, config: AlignConfig = DEFAULT) -> Iterator[Chain]:
    """The chains of one attempt on a reference that a task holds, in lexicographic order; neighbouring tiles without a
    place are put together."""
    hits = [occurrences(t, ref.text) for t in tiles]
    merged: list[str] = []
    found: list[int] = []
    for k, tile in enumerate(tiles):
        if k and not hits[k] and not hits[k - 1]:
            merged[-1] += tile
            continue
        if hits[k]:
            found.append(len(merged))
        merged.append(tile)
    for path in paths([h for h in hits if h], config.max_gap):
        places = [-1] * len(merged)
        for k, p in zip(found, path):
            places[k] = p
        yield Chain(ref, read, places, merged)


def near_round(reads: DataFrame, near: DataFrame, mean: int, parts: int, config: AlignConfig = DEFAULT) -> DataFrame:
    """What ``map_round`` gives for all attempts, of reads whose references go to them whole: one shuffle by reference, in
    which one of very many reads is dealt out, and nothing written but the mappings.

    Attempts are made one after the other, those of all reads of an Arrow batch together, and a read's end at its first success.
    """
    rows = spread_join(reads.select(*READ), near, ["ref_id"], "often", ["read_idx"], parts).select(*READ, "text")
    keys = ["ref_id", "read_idx", "pair_id", "mate"]
    types = ", ".join(f"{c} {t}" for c, t in rows.select(*keys).dtypes)
    mapping = pa.struct([("position", pa.int32()), ("mismatches", pa.list_(pa.struct([("position", pa.int32()), ("new_base", pa.string())]))), ("indels", pa.list_(pa.struct([("type", pa.string()), ("position", pa.int32()), ("length", pa.int32())])))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seqs, texts = batch.column(READ.index("seq")).to_pylist(), batch.column(len(READ)).to_pylist()
            live = {at: tries(seq, config) for at, seq in enumerate(seqs)}

            def wave(live: dict = live, seqs: list = seqs, texts: list = texts) -> Iterator[tuple[int, Chain]]:
                for at in list(live):
                    attempt = next(live[at], None)
                    if attempt is None:
                        del live[at]
                        continue
                    for chain in tile_chains(seqs[at], attempt[1], Window(texts[at], 0, len(texts[at])), config):
                        yield at, chain

            while live:
                lazy, count = wave(), {}
                while some := list(islice(lazy, CHAINS)):
                    out = []
                    for (at, _), (m, broken) in zip(some, place_many([c for _, c in some], mean, config)):
                        if m is not None or broken:
                            out.append((at, count.get(at, 0), None if m is None else m.row(), broken))
                            count[at] = count.get(at, 0) + (m is not None)
                    if out:
                        at, n, found, broken = zip(*out)
                        taken = batch.select(keys).take(pa.array(at))
                        yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(n, pa.int64()), pa.array(found, mapping), pa.array(broken)], [*keys, "map_idx", "mapping", "failed"])
                for at in count:
                    live.pop(at, None)

    return written(rows.mapInArrow(run, f"{types}, map_idx long, mapping {MAPPING}, failed boolean"), "map-placed").select(*keys, "mapping", "map_idx", "failed")


def map_rounds(reads: DataFrame, refs: DataFrame, mean: int, config: AlignConfig = DEFAULT, small: int = SMALL, summary: Summary | None = None) -> DataFrame:
    """What ``map_round`` gives for all attempts, of reads of short references by ``near_round``, of others in rounds over
    the reads that are still unmapped.

    First the first division without padding, then the other divisions, then one padding a round. Once ``small`` reads or
    fewer are left, all their other attempts make one round, in which each task stops a read at its first success.
    """
    last = config.max_padding * PADDING + PADDING - 1
    rounds = [(0, 0), (1, PADDING - 1), *[(p * PADDING, p * PADDING + PADDING - 1) for p in range(1, config.max_padding + 1)]]
    rest, maps, done = reads.filter(F.length("seq") > config.min_length), None, False
    near, far = near_references(rest, refs)
    if near is not None:
        if far is not None:
            rest = written(with_length(rest, refs), "map-rest")
        some = rest if far is None else rest.filter(F.col("ref_length") <= NEAR)
        left, n = some.count(), int(reads.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        maps = near_round(some, near, mean, max(n, -(-left // READS)), config)
        if summary is not None:
            summary.rounds.append((0, last, left))
        if far is None:
            return maps
        rest, refs = rest.filter(F.col("ref_length") > NEAR), far
    for k, (low, high) in enumerate(rounds):
        left = rest.count()
        if done or (not left and k):
            break
        if k and left <= small:
            high, done = last, True  # noqa: PLW2901
        if summary is not None:
            summary.rounds.append((low, high, left))
        tried = attempts(rest, range(low // PADDING, high // PADDING + 1), config).filter(F.col("attempt").between(low, high))
        got = map_round(tried, refs, mean, config)
        maps = got if maps is None else maps.unionByName(got)
        if not done:
            rest = written(rest.join(got.select("read_idx").distinct(), "read_idx", "left_anti"), "map-rest")
    return maps


def read_mappings(reads: DataFrame, refs: DataFrame, config: AlignConfig = DEFAULT, small: int = SMALL) -> DataFrame:
    """ref_id, read_idx, pair_id, mate, map_idx (from 0), mapping: all mappings of each read, each read by itself.

    Those of its first attempt that gives any, in order of their chains. Reads that can't be mapped, or of which one
    mapping can't be computed, have no rows. For ``reads`` and ``refs`` see ``map_reads``. No reads: no rows.
    """
    mean = mean_read_length(reads).first()["mean_read_length"] or 0
    found = map_rounds(written(reads, "map-input"), refs, mean, config, small)
    bad = found.filter("failed").select("read_idx").distinct()
    return found.join(bad, "read_idx", "left_anti").filter("mapping is not null").select("ref_id", "read_idx", "pair_id", "mate", "map_idx", "mapping")


def map_reads(reads: DataFrame, refs: DataFrame, config: AlignConfig = DEFAULT, small: int = SMALL, summary: Summary | None = None) -> DataFrame:
    """``reads`` with the chosen mapping (null: unmapped), from exact tiles, chains and local alignment.

    ``reads``: ref_id, read_idx (unique), pair_id, mate (0 or 1), seq; ``refs``: whole sequences or parts, see
    ``operators.references``, with ref_id unique among whole ones. Reads that are null or too short, or whose ref_id is
    null or isn't in ``refs``, stay unmapped. If a read's mapping can't be computed, both mates of its pair stay
    unmapped, whatever the other one gave. ``summary`` gets what was counted on the way.
    """
    mean = mean_read_length(reads).first()["mean_read_length"]
    if mean is None:
        return reads.withColumn("mapping", F.lit(None).cast(MAPPING))
    reads = written(reads, "map-input")
    maps = map_rounds(reads, refs, mean, config, small, summary)
    bad, done = Observation(), Observation()
    failed = written(maps.filter("failed").select("pair_id").distinct().observe(bad, F.count(F.lit(1)).alias("pairs")), "map-failed")
    good = maps.join(failed, "pair_id", "left_anti").filter("mapping is not null")
    chosen = select_pairs(good.select("pair_id", "mate", "read_idx", "map_idx", "mapping"), length_adjust())
    out = reads.join(chosen.select("read_idx", "mapping"), "read_idx", "left")
    out = written(out.observe(done, F.count(F.lit(1)).alias("reads"), F.count("mapping").alias("mapped")), "map-reads")
    if summary is not None:
        summary.failed_pairs, summary.reads, summary.mapped = bad.get["pairs"], done.get["reads"], done.get["mapped"]
    return out


def with_length(rows: DataFrame, refs: DataFrame) -> DataFrame:
    """``rows`` with the ref_length of their reference; a reference of very many rows is dealt out."""
    often = rows.groupBy("ref_id").agg(F.count(F.lit(1)).alias("often"))
    return spread_join(rows.filter(F.col("ref_id").isNotNull()), written(lengths(refs).join(often, "ref_id"), "lengths"), ["ref_id"], "often", ["read_idx"])


def mutations(mapped: DataFrame, refs: DataFrame, summary: Summary | None = None) -> DataFrame:
    """ref_id, position, type, new_base, n: at most one mutation a position, found in more than half of the reads there.

    ``mapped``: ref_id, read_idx (unique), seq, mapping; rows without a mapping or a reference have no vote. No rows: no
    calls. ``summary`` gets the mean coverage, over the references that reads map to, and the indels left out
    because their read has another one at the position.
    """
    cover, gone = Observation(), Observation()
    rows = active(with_length(mapped.filter("mapping is not null"), refs), length_adjust(), F.col("ref_length"))
    inside = F.greatest(F.lit(0), F.least("end", "ref_length") - F.least("start", "ref_length"))
    rows = written(rows.observe(cover, F.coalesce(F.sum(inside.cast("long")), F.lit(0).cast("long")).alias("bases")), "map-active")
    votes = written(read_mutations(rows, gone), "map-votes")
    if summary is not None:
        summary.bases, summary.dropped_indels = cover.get["bases"], gone.get["dropped"]
        met = lengths(refs).join(rows.select("ref_id").distinct(), "ref_id", "left_semi").agg(F.sum("ref_length").alias("n")).first()["n"]
        summary.coverage = summary.bases / met if met else 0.0
    where = votes.select("ref_id", "position").distinct()
    total = depth(rows.select("ref_id", "start", "end"), ["ref_id"], where).withColumnRenamed("depth", "total")
    return majority(votes, ["ref_id", "position"], ["type", "new_base"], ["start", "read_idx", "turn"], total)


def chunks(size: Column, mean: int, config: AlignConfig = DEFAULT, skip_covered_tail: bool = False) -> Column:
    """The parts (left, right) in which a reference of ``size`` bases is aligned as a whole: one, or overlapping ones.

    With ``skip_covered_tail`` a part that begins within the last two mean lengths is left out: the one before covers it.
    """
    step = config.chunk - 2 * mean
    starts = F.sequence(F.lit(0), F.greatest(size - 1, F.lit(0)), F.lit(step))
    if skip_covered_tail:
        starts = F.filter(starts, lambda x: (x == 0) | (x < size - 2 * mean))
    part = lambda x: F.struct(x.cast("int").alias("left"), F.least(x + config.chunk, size).cast("int").alias("right"))
    return F.when(size <= config.chunk, F.array(part(F.lit(0)))).otherwise(F.transform(starts, part))


def chunk_pairs(reads: DataFrame, refs: DataFrame, mean: int, config: AlignConfig, together: int, skip_covered_tail: bool) -> DataFrame:
    """left, right, rows (read_idx, seq), ref, ref_length: groups of ``together`` reads with each chunk of their reference."""
    step = config.chunk - 2 * mean
    rows = with_length(reads.filter(F.length("seq") > 0), refs)
    groups = rows.groupBy("ref_id", "ref_length", F.expr(f"read_idx div {together}").alias("g")).agg(F.collect_list(F.struct("read_idx", "seq")).alias("rows"))
    groups = written(groups.withColumn("salt", F.expr(f"g div {PORTION}")), "whole-groups")
    left = F.explode(F.transform(chunks(F.col("ref_length"), mean, config, skip_covered_tail), lambda c: c["left"].cast("long"))).alias("left")
    wanted = groups.select("ref_id", "ref_length", "salt").distinct().select("ref_id", "salt", left)
    keys, n = ["ref_id", "left", "salt"], int(reads.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # much work: not to be coalesced
    parts = cut(refs, step, config.chunk + 1 - step).select("ref_id", F.col("from").alias("left"), F.col("part").alias("ref"))
    parts = parts.join(wanted, ["ref_id", "left"]).repartition(n, *keys)
    pairs = groups.select("ref_id", "ref_length", "salt", "rows", left).repartition(n, *keys).join(parts, keys)
    return pairs.select("left", F.least(F.col("left") + config.chunk, "ref_length").alias("right"), "rows", "ref", "ref_length")


def equal_places(pairs: DataFrame, config: AlignConfig = DEFAULT) -> DataFrame:
    """read_idx, mapping of the reads that stand unchanged in a chunk, and whose mapping this alone decides.

    Such a place has the greatest score and no error, and of several the first counts. In an earlier chunk only a read
    that is left out in full would be as free of errors; that is so if no score there is above the tolerance, which
    the last letters of the read rule out where they occur: a score of -1 or more goes on with 2 for each of them.
    """
    tail = (config.tolerance + 1) // 2 + 1
    each = pairs.select("left", "ref", F.explode("rows").alias("x")).select("left", "ref", "x.*")
    seen = F.call_function("locate", F.col("seq"), F.col("ref"), F.lit(1))
    ends = F.call_function("locate", F.expr(f"right(seq, {tail})"), F.col("ref"), F.lit(1))
    each = each.filter(F.length("seq") >= tail).select("read_idx", "left", seen.alias("seen"), (ends == 0).alias("open"))
    first = each.groupBy("read_idx").agg(F.min(F.when(F.col("seen") > 0, F.struct("left", "seen"))).alias("at"), F.min(F.when(F.col("open"), F.col("left"))).alias("open"))
    first = first.filter(F.col("at").isNotNull() & (F.col("open").isNull() | (F.col("open") > F.col("at.left"))))
    none = [F.array().cast(t) for t in ("array<struct<position:int,new_base:string>>", "array<struct<type:string,position:int,length:int>>")]
    place = (F.col("at.left") + F.col("at.seen") - 1).cast("int")
    return first.select("read_idx", F.struct(place.alias("position"), none[0].alias("mismatches"), none[1].alias("indels")).cast(MAPPING).alias("mapping"))


def whole_alignment(reads: DataFrame, refs: DataFrame, mean: int, config: AlignConfig = DEFAULT, together: int = 64, skip_covered_tail: bool = False) -> DataFrame:
    """``reads`` with the best mapping on the whole reference: a long one is cut into overlapping chunks, and the
    chunk with the fewest errors counts, of equals the first.

    Reads that stand unchanged in a chunk are placed by a plain search (``equal_places``). Of the others ``together`` go
    to Python with one copy of a chunk. Groups of reads meet chunks by reference, chunk and a
    portion of the groups, so neither a reference nor a chunk is joined in one place. Null or empty reads, and reads
    without a reference, stay unmapped; read_idx is unique, and so is ref_id among whole sequences. No reads: no rows.
    """
    equal = written(equal_places(chunk_pairs(reads, refs, mean, config, together, skip_covered_tail), config), "whole-equal")
    rest = reads.join(equal.select("read_idx"), "read_idx", "left_anti")
    pairs = chunk_pairs(rest, refs, mean, config, together, skip_covered_tail)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            tasks: list[Task] = []
            keys: list[tuple[int, int]] = []
            bases = 0
            for r in f.itertuples(index=False):
                window = Window(r.ref, r.left, r.ref_length)
                tasks += [Task(window, x["seq"], r.left, r.right) for x in r.rows]
                keys += [(x["read_idx"], r.left) for x in r.rows]
                bases += len(r.ref) * len(r.rows)
                if bases > MOST_BASES:  # chunks of one size are aligned together
                    yield aligned(tasks, keys)
                    tasks, keys, bases = [], [], 0
            if tasks:
                yield aligned(tasks, keys)

    def aligned(tasks: list[Task], keys: list[tuple[int, int]]) -> pd.DataFrame:
        found = align_many(tasks, config.max_gap, config.tolerance)
        return pd.DataFrame({"read_idx": [k for k, _ in keys], "left": [x for _, x in keys], "mapping": [m.row() if m else None for m in found]})

    got = pairs.mapInPandas(run, f"read_idx long, left long, mapping {MAPPING}")
    best = got.filter("mapping is not null").groupBy("read_idx").agg(F.min_by("mapping", F.struct(num_errors(), "left")).alias("mapping"))
    return reads.join(best.unionByName(equal), "read_idx", "left")


def map_files(spark: SparkSession, reference: str, reads: str, order: bool = False, summary: Summary | None = None) -> DataFrame:
    """The command: mutation lines of a reads file (position, line), or with ``order`` its labels in mapped order
    (rank, label, position). Rows are in the order of their first column. ValueError if there isn't just one reference."""
    parts = written(reference_parts(spark, reference), "reference-parts")
    names = [r["ref_id"] for r in parts.select("ref_id").distinct().limit(2).collect()]
    if len(names) != 1:
        raise ValueError(f"one reference is needed in {reference}")
    ref, rows = parts.filter("part != ''"), read_reads(spark, reads).withColumn("ref_id", F.lit(names[0]))
    if order:
        mean = mean_read_length(rows).first()["mean_read_length"] or 0
        placed = whole_alignment(rows, ref, mean).withColumn("position", F.col("mapping")["position"])
        if summary is not None:
            seen = Observation()
            placed = written(placed.observe(seen, F.count(F.lit(1)).alias("reads"), F.count("position").alias("mapped")), "map-order")
            summary.reads, summary.mapped = seen.get["reads"], seen.get["mapped"]
        return mapping_order(placed).orderBy("rank")
    calls = mutations(map_reads(rows, ref, summary=summary), ref, summary)
    return mutation_lines(calls, ref).select("position", "line").orderBy("position")
