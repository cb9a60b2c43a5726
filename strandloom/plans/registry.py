"""The queries over the sequence operators, and their SQL.

Texts become sequences over ACGT; each document is a reference of its own, benchmark items are patterns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandloom.config import AlignConfig
from strandloom.functions.sequence import MAPPING, alignment_view, bases, chain_count, chains, has_hit, insertion_point, ladder, length_adjust, mapping_text, merge_unmatched, mutation_form, mutation_key, num_errors, pair_form, read_form, tiles, ungapped
from strandloom.operators.find import exact_find, suffix_bounds, suffix_order
from strandloom.operators.find import seed_hits as find_seeds
from strandloom.operators.pairs import first_success, nearest_ahead, select_pairs
from strandloom.operators.paths import streamed_chains
from strandloom.operators.pileup import active, depth, majority, mapping_order, mutation_lines, ranked, read_mutations
from strandloom.plans.mapping import attempts, chunks, map_reads, mutations, read_mappings, whole_alignment
from strandloom.sources.shared import written
from strandloom.sources.text import concat_lines, mean_read_length


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """A table of fewer files than cores is dealt out, as one file may be one task; others stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if len(df.inputFiles()) < cores else df


def references(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text")).select(F.col("doc_id").alias("ref_id"), bases().alias("seq"))


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select("item_id", bases().alias("seq"))


def reference_concat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return concat_lines(table(spark, sf_dir, "documents"), "text").select("doc_id", "seq")


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = table(spark, sf_dir, "conversations").withColumn("rec", (F.row_number().over(order) - 1).cast("long")).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("conv_id")))
    rows = rows.filter(F.col("rec") < F.expr("n - n % 2"))
    return rows.select("conv_id", F.expr("rec div 2").alias("pair_id"), (F.col("rec") % 2).cast("int").alias("mate"), F.col("role").alias("label"), F.col("text").alias("seq"))


def read_pairing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns(spark, sf_dir)


def mean_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mean_read_length(turns(spark, sf_dir))


def short_read_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = references(spark, sf_dir).filter(F.length("seq") > 15)
    return rows.select("ref_id", F.length("seq").alias("length"), F.array_join(ladder(F.length("seq"), 0), ",").alias("divisions"))


def tile_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = items(spark, sf_dir).withColumn("padding", F.explode(F.sequence(F.lit(0), F.lit(10))))
    rows = rows.withColumn("div", F.explode(F.array(*[F.lit(d) for d in range(2, 9)])))
    return rows.select("item_id", "padding", "div", F.posexplode(tiles(F.col("seq"), F.col("padding"), F.col("div"))).alias("tile_idx", "tile"))


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    patterns = items(spark, sf_dir).select(F.col("item_id").alias("pattern_id"), F.col("seq").alias("pattern"))
    return exact_find(references(spark, sf_dir), patterns).withColumnRenamed("pattern_id", "item_id")


def exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return found(spark, sf_dir)


def coverage_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = found(spark, sf_dir).join(items(spark, sf_dir), "item_id")
    return depth(hits.select("ref_id", F.col("pos").alias("start"), (F.col("pos") + F.length("seq")).alias("end")), ["ref_id"])


def mean_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = found(spark, sf_dir).join(items(spark, sf_dir), "item_id").groupBy("ref_id").agg(F.sum(F.length("seq")).alias("covered"))
    refs = references(spark, sf_dir).filter(F.length("seq") > 0).select("ref_id", F.length("seq").alias("bases"))
    return refs.join(hits, "ref_id", "left").select("ref_id", (F.coalesce("covered", F.lit(0)) / F.col("bases")).alias("mean_coverage"))


def mapping_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = found(spark, sf_dir).select("item_id").distinct().withColumn("hit", F.lit(1))
    return items(spark, sf_dir).join(hits, "item_id", "left").agg(F.count("hit").alias("mapped"), F.count(F.lit(1)).alias("reads"))


def item_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = found(spark, sf_dir).groupBy("item_id").agg(F.min("pos").alias("position"))
    rows = items(spark, sf_dir).join(first, "item_id", "left")
    return ranked(rows.select("item_id", "position"), "position", "item_id").select("rank", "item_id", "position")


def tile_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where an item's three tiles stand in each document."""
    cut = items(spark, sf_dir).select("item_id", F.posexplode(tiles(F.col("seq"), F.lit(0), F.lit(3))).alias("tile_idx", "pattern"))
    return find_seeds(cut.select(F.struct("item_id", "tile_idx").alias("pattern_id"), "pattern"), references(spark, sf_dir)).select("ref_id", "pattern_id.*", "hits")


def joined(values) -> Column:
    return F.array_join(F.transform(values, lambda p: p.cast("string")), ",")


def seed_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tile_hits(spark, sf_dir).withColumn("hits", joined("hits"))


def increasing_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chains through the places at which an item's three tiles stand in a document; a tile may not be there at all."""
    rows = tile_hits(spark, sf_dir).groupBy("ref_id", "item_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("tile_idx", "hits"))), lambda x: x["hits"]).alias("h"))
    got = rows.select("ref_id", "item_id", F.explode(chains(F.col("h"), 1000)).alias("chain"))
    return got.select("ref_id", "item_id", joined("chain").alias("chain"))


def chain_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An item's places in a document by tile, none for a tile that isn't there."""
    rows = tile_hits(spark, sf_dir).groupBy("ref_id", "item_id").agg(F.map_from_entries(F.collect_list(F.struct("tile_idx", "hits"))).alias("of"))
    return rows.select("ref_id", "item_id", F.array(*[F.coalesce(F.try_element_at("of", F.lit(k)), F.array().cast("array<int>")) for k in range(3)]).alias("h"))


def chain_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many chains an item has in a document, a tile that isn't there left out; none is made for it."""
    return chain_hits(spark, sf_dir).select("ref_id", "item_id", chain_count(F.col("h"), 1000).alias("n_chains"))


def chain_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """These chains themselves, made one after the other."""
    return streamed_chains(chain_hits(spark, sf_dir), ["ref_id", "item_id"], "h", 1000).withColumn("chain", joined("chain"))


def pair_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    side = lambda kind, name: events.filter(F.col("event_type") == kind).select("user_id", F.col("event_id").alias("ord"), F.col("us").alias(name))
    return nearest_ahead(side("click", "reach"), side("purchase", "place"), "user_id")


def majority_call(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").withColumn("hour", F.hour("ts"))
    totals = events.groupBy("user_id", "hour").agg(F.count(F.lit(1)).alias("total"))
    return majority(events, ["user_id", "hour"], ["event_type"], ["event_id"], totals)


def global_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chunks in which each document would be aligned as a whole, for reads as long as turns are on average."""
    mean = mean_read_length(turns(spark, sf_dir)).first()["mean_read_length"] or 0
    rows = table(spark, sf_dir, "documents").select("doc_id", F.explode(chunks(F.length("text"), mean)).alias("c"))
    return rows.select("doc_id", "c.left", "c.right")


def padded_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every padding and division that the items are tried with as reads, and the tiles at either end."""
    reads = items(spark, sf_dir).select(F.lit(0).alias("ref_id"), F.col("item_id").alias("read_idx"), F.col("item_id").alias("pair_id"), F.lit(0).alias("mate"), "seq")
    return attempts(reads, range(11)).select("read_idx", "attempt", F.size("parts").alias("n_tiles"), F.col("parts")[0].alias("first_tile"), F.element_at("parts", -1).alias("last_tile"))


def order_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order's lines as a chain: lines of over 25 pieces are found, at ten times their number; their flags are the tiles."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", F.struct("l_linenumber", "l_partkey", "l_suppkey", F.when(F.col("l_quantity") > 25, F.col("l_linenumber") * 10).otherwise(-1).alias("p"), F.concat("l_returnflag", "l_linestatus").alias("t")).alias("x"))
    rows = rows.groupBy("l_orderkey").agg(F.sort_array(F.collect_list("x")).alias("xs"))
    return rows.select("l_orderkey", F.transform("xs", lambda x: x["p"]).alias("chain"), F.transform("xs", lambda x: x["t"]).alias("parts"))


def unmatched_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = order_lines(spark, sf_dir).withColumn("m", merge_unmatched(F.col("chain"), F.col("parts")))
    return rows.select("l_orderkey", joined(F.transform("m", lambda x: x["position"])).alias("places"), F.array_join(F.transform("m", lambda x: x["tile"]), ",").alias("tiles"))


def hit_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_lines(spark, sf_dir).filter(has_hit(F.col("chain"))).select("l_orderkey", joined("chain").alias("chain"))


def insertion_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where a customer's balance would stand among the prices of the customer's orders."""
    prices = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.sort_array(F.collect_list("o_totalprice")).alias("prices"))
    rows = table(spark, sf_dir, "customer").join(prices, F.col("c_custkey") == F.col("o_custkey"), "left")
    return rows.select("c_custkey", insertion_point(F.coalesce("prices", F.array().cast("array<double>")), F.col("c_acctbal")).alias("place"))


def suffix_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_order(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("ref_id"), F.col("c_name").alias("seq")))


def suffix_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which places in the order of all suffixes of each document an item takes that occurs in it."""
    refs = written(references(spark, sf_dir), "references")
    patterns = items(spark, sf_dir).select(F.col("item_id").alias("pattern_id"), F.col("seq").alias("pattern"))
    hits = written(exact_find(refs, patterns), "suffix-hits")
    # A document in which no item occurs has no row: only the suffixes of the others need an order.
    met = refs.join(hits.select("ref_id").distinct(), "ref_id", "left_semi")
    return suffix_bounds(suffix_order(written(met, "suffix-refs")), hits).withColumnRenamed("pattern_id", "item_id")


def first_purchase(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's purchases in the first hour of a day that has any, as attempts and successes."""
    events = table(spark, sf_dir, "events").withColumn("hour", F.hour("ts"))
    return first_success(events, "user_id", "hour", "event_type = 'purchase'").select("user_id", "hour", "event_id")


def mate_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clicks and purchases of a user as mappings of two mates, a click's with a deletion: the pair that is chosen."""
    events = table(spark, sf_dir, "events").filter("event_type in ('click', 'purchase')")
    mate = F.when(F.col("event_type") == "click", 0).otherwise(1)
    place = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000).cast("int")
    gap = F.when(mate == 0, F.array(F.struct(F.lit("D").alias("type"), place.alias("position"), F.floor(F.col("value")).cast("int").alias("length")))).otherwise(F.array().cast("array<struct<type:string,position:int,length:int>>"))
    mapping = F.struct(place.alias("position"), F.array().cast("array<struct<position:int,new_base:string>>").alias("mismatches"), gap.alias("indels")).cast(MAPPING)
    maps = events.select(F.col("user_id").alias("pair_id"), mate.alias("mate"), F.col("event_id").alias("read_idx"), F.col("event_id").alias("map_idx"), mapping.alias("mapping"))
    return select_pairs(maps, length_adjust()).select("pair_id", "mate", "map_idx", F.col("mapping.position").alias("position"))


#: Lines that one task gathers to orders, about.
GATHERED = 250_000


def mapped_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as mapped reads: an order's customer names the document it maps to, its key the place, its lines the
    mismatches (returned) and indels (accepted: deletions, not returned: insertions)."""
    place = (F.col("o_orderkey") * 7 % 40).cast("int")
    lines = table(spark, sf_dir, "lineitem")
    # Lines meet their orders once, by key: parts grow in number, not in size. What the lines need of an order is its key.
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-lines.count() // GATHERED))
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("ref_id"), F.col("o_orderkey").alias("read_idx"), place.alias("position"), bases("concat(o_orderpriority, o_orderstatus, 'thequickbrownfox')").alias("seq"))
    at = (F.col("l_orderkey") * 7 % 40).cast("int") + F.col("l_linenumber") * 3
    lines = lines.select("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag").repartition(parts, "l_orderkey")
    wrong = F.when(F.col("l_returnflag") == "R", F.struct(at.alias("position"), F.substring(F.lit("ACGT"), at % 4 + 1, F.lit(1)).alias("new_base")))
    kind = F.when(F.col("l_returnflag") == "A", "D").when(F.col("l_returnflag") == "N", "I")
    gap = F.when(kind.isNotNull(), F.struct(at.alias("position"), F.col("l_partkey"), kind.alias("type"), (F.col("l_partkey") % 3).cast("int").alias("length")))
    edits = lines.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(wrong)).alias("mismatches"), F.sort_array(F.collect_list(gap)).alias("gaps"))
    rows = orders.repartition(parts, "read_idx").join(edits, F.col("read_idx") == F.col("l_orderkey"), "left")
    indels = F.transform(F.coalesce("gaps", F.array().cast(edits.schema["gaps"].dataType)), lambda g: F.struct(g["type"].alias("type"), g["position"].alias("position"), g["length"].alias("length")))
    mapping = F.struct("position", F.coalesce("mismatches", F.array().cast(edits.schema["mismatches"].dataType)).alias("mismatches"), indels.alias("indels")).cast(MAPPING)
    return rows.select("ref_id", "read_idx", "seq", mapping.alias("mapping"))


def mapping_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mapped_orders(spark, sf_dir).select("read_idx", num_errors().alias("errors"), length_adjust().alias("adjust"), mapping_text().alias("line"))


def with_span(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs = references(spark, sf_dir).select("ref_id", F.length("seq").alias("ref_length"))
    return active(mapped_orders(spark, sf_dir).join(refs, "ref_id"), length_adjust(), F.col("ref_length"))


def active_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return depth(with_span(spark, sf_dir), ["ref_id"])


def pileup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_mutations(with_span(spark, sf_dir)).select("ref_id", "read_idx", "position", "type", "new_base")


def called_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Both are read several times: bases are made, and lines gathered, once.
    refs, mapped = written(references(spark, sf_dir), "references"), written(mapped_orders(spark, sf_dir), "mapped-orders")
    return mutation_lines(mutations(mapped, refs), refs)


def planted_reads(spark: SparkSession, sf_dir: str, indels: bool = False) -> tuple[DataFrame, DataFrame]:
    """Each customer's orders are a reference: the digests of their keys, one after the other, as bases. Three pairs of
    mates come from each, 4 bases apart; the left ones cover base 30, which two of them have changed if the reference
    has 64 bases or more. The right ones begin 60 bases on, where the reference is that long.

    With ``indels`` customers of an even key have the base deleted instead, if it differs from its neighbours, and the
    others a base inserted before it, which differs from both sides."""
    part = F.translate(F.md5(F.col("o_orderkey").cast("string")), "0123456789abcdef", "ACGT" * 4)
    refs = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("ref_id")).agg(F.sort_array(F.collect_list(F.struct("o_orderkey", part.alias("part")))).alias("parts"))
    refs = written(refs.select("ref_id", F.array_join(F.transform("parts", lambda x: x["part"]), "").alias("seq")), "planted")
    rows = refs.withColumn("k", F.explode(F.array(*[F.lit(k) for k in range(3)])))
    base = lambda i: F.substring("seq", i + 1, 1)
    front, behind = F.substring("seq", 1, 30), F.expr("substring(seq, 32)")
    other, good = F.concat(front, F.translate(base(30), "ACGT", "GTAC"), behind), F.length("seq") >= 64
    if indels:
        new = F.translate(base(30), "ACGT", "CGTA")
        new = F.when(new != base(29), new).otherwise(F.translate(base(30), "ACGT", "GTAC"))
        lost = F.col("ref_id") % 2 == 0
        other = F.when(lost, F.concat(front, behind)).otherwise(F.concat(front, new, base(30), behind))
        good = good & (~lost | ((base(29) != base(30)) & (base(30) != base(31))))
    left = F.expr("substring(source, k * 4 + 1, 50)")
    rows = rows.withColumn("source", F.when(good & (F.col("k") < 2), other).otherwise(F.col("seq")))
    reads = rows.select("ref_id", "k", F.posexplode(F.array(left, F.expr("substring(seq, k * 4 + 61, 50)"))).alias("mate", "seq"))
    pair = F.col("ref_id") * 3 + F.col("k")
    return reads.select("ref_id", (pair * 2 + F.col("mate")).alias("read_idx"), pair.alias("pair_id"), "mate", pair.cast("string").alias("label"), "seq"), refs


def planted_long(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """References of the orders of 256 keys each, about 2000 bases, and of each two reads of 50 bases, at 300 and at 1500
    where it is that long."""
    part = F.translate(F.md5(F.col("o_orderkey").cast("string")), "0123456789abcdef", "ACGT" * 4)
    refs = table(spark, sf_dir, "orders").groupBy(F.expr("o_orderkey div 256").alias("ref_id")).agg(F.sort_array(F.collect_list(F.struct("o_orderkey", part.alias("part")))).alias("parts"))
    refs = written(refs.select("ref_id", F.array_join(F.transform("parts", lambda x: x["part"]), "").alias("seq")), "planted")
    reads = refs.select("ref_id", F.posexplode(F.array(F.expr("substring(seq, 301, 50)"), F.expr("substring(seq, 1501, 50)"))).alias("k", "seq")).filter(F.length("seq") == 50)
    return reads.select("ref_id", (F.col("ref_id") * 2 + F.col("k")).alias("read_idx"), F.concat("ref_id", F.lit("-"), "k").alias("label"), "seq"), refs


def call_mutations(spark: SparkSession, sf_dir: str) -> DataFrame:
    reads, refs = planted_reads(spark, sf_dir)
    return mutations(map_reads(reads, refs), refs)


def mapped_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each read of the planted pairs maps, and its mapping as text."""
    reads, refs = planted_reads(spark, sf_dir)
    return map_reads(reads, refs).select("read_idx", F.col("mapping.position").alias("position"), F.when(F.col("mapping").isNotNull(), mapping_text()).alias("line"))


def map_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The left mates of the planted pairs, aligned with their whole references, in mapped order."""
    reads, refs = planted_reads(spark, sf_dir)
    placed = whole_alignment(reads.filter("mate = 0"), refs, 50)
    return mapping_order(placed.withColumn("position", F.col("mapping")["position"]))


def call_indels(spark: SparkSession, sf_dir: str) -> DataFrame:
    reads, refs = planted_reads(spark, sf_dir, indels=True)
    return mutations(map_reads(reads, refs), refs)


def mapped_indels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each read maps whose pairs have indels planted, and its mapping as text."""
    reads, refs = planted_reads(spark, sf_dir, indels=True)
    return map_reads(reads, refs).select("read_idx", F.col("mapping.position").alias("position"), F.when(F.col("mapping").isNotNull(), mapping_text()).alias("line"))


def map_order_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads aligned with references that are cut into overlapping chunks of 1100 bases, in mapped order."""
    reads, refs = planted_long(spark, sf_dir)
    placed = whole_alignment(reads, refs, 50, AlignConfig(chunk=1100))
    return mapping_order(placed.withColumn("position", F.col("mapping")["position"]))


def alignment_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The planted left mates with indels as two lines each, by the mapping that they are made with, and the reads and
    reference parts that the lines give back."""
    reads, refs = planted_reads(spark, sf_dir, indels=True)
    rows = reads.filter("mate = 0").join(refs.select("ref_id", F.col("seq").alias("ref")), "ref_id")
    k = (F.col("pair_id") % 3 * 4).cast("int")
    changed = F.col("seq") != F.expr("substring(ref, cast(pair_id % 3 * 4 as int) + 1, 50)")
    gap = F.struct(F.when(F.col("ref_id") % 2 == 0, "D").otherwise("I").alias("type"), F.lit(30).alias("position"), F.lit(1).alias("length"))
    mapping = F.struct(k.alias("position"), F.array().cast("array<struct<position:int,new_base:string>>").alias("mismatches"), F.when(changed, F.array(gap)).otherwise(F.array().cast("array<struct<type:string,position:int,length:int>>")).alias("indels")).cast(MAPPING)
    view = rows.withColumn("mapping", mapping).select("pair_id", alignment_view(F.col("ref"), F.col("seq")).alias("v"))
    return view.select("pair_id", "v.top", "v.low", ungapped(F.col("v.low")).alias("read"), ungapped(F.col("v.top")).alias("part"))


def long_insertion_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each supplier's balance would stand among all prices of a month's orders."""
    prices = table(spark, sf_dir, "orders").groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("month")).agg(F.sort_array(F.collect_list("o_totalprice")).alias("prices"))
    asked = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_acctbal") * 20, F.date_format(F.date_add(F.lit("1995-01-01").cast("date"), F.col("s_suppkey").cast("int")), "yyyy-MM").alias("month")).toDF("s_suppkey", "balance", "month")
    return asked.join(prices, "month").select("s_suppkey", insertion_point(F.col("prices"), F.col("balance")).alias("place"))


def all_mappings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All mappings of the planted left mates, unchanged, on references that hold each sequence twice."""
    _, refs = planted_reads(spark, sf_dir)
    rows = refs.withColumn("k", F.explode(F.array(*[F.lit(k) for k in range(3)])))
    reads = rows.select("ref_id", (F.col("ref_id") * 3 + F.col("k")).alias("read_idx"), (F.col("ref_id") * 3 + F.col("k")).alias("pair_id"), F.lit(0).alias("mate"), F.expr("substring(seq, k * 4 + 1, 50)").alias("seq"))
    found = read_mappings(reads, refs.select("ref_id", F.concat("seq", "seq").alias("seq")))
    return found.select("read_idx", "map_idx", F.col("mapping.position").alias("position"), num_errors().alias("errors"))


def text_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as mapped reads, written out in full."""
    return mapped_orders(spark, sf_dir).select("read_idx", read_form(F.col("seq"), F.col("mapping")).alias("form"))


def mutation_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every mutation of every read, written out: the trace of the pileup."""
    return pileup(spark, sf_dir).select("ref_id", "read_idx", mutation_form(F.col("type"), F.col("position"), F.col("new_base")).alias("form"))


def distinct_mutations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many different mutations the reads of each document have, and how often they were seen."""
    rows = pileup(spark, sf_dir).select("ref_id", mutation_key(F.col("type"), F.col("position"), F.col("new_base")).alias("key"))
    rows = rows.groupBy("ref_id", "key").agg(F.count(F.lit(1)).alias("n"))
    return rows.groupBy("ref_id").agg(F.count(F.lit(1)).alias("different"), F.sum("n").alias("seen"))


def pair_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = turns(spark, sf_dir).groupBy("conv_id", "pair_id").agg(F.max(F.when(F.col("mate") == 0, F.col("seq"))).alias("a"), F.max(F.when(F.col("mate") == 1, F.col("seq"))).alias("b"))
    return rows.select("conv_id", "pair_id", pair_form(F.col("a"), F.col("b")).alias("form"))


FLAGSHIP = "coverage_depth"
QUERIES = {
    "reference_concat": reference_concat, "read_pairing": read_pairing, "mean_read_length": mean_length, "short_read_filter": short_read_filter,
    "tile_reads": tile_reads, "exact_find": exact, "coverage_depth": coverage_depth, "mean_coverage": mean_coverage, "mapping_rate": mapping_rate,
    "mapping_order": item_order, "increasing_chains": increasing_chains, "pair_select": pair_select, "majority_call": majority_call,
    "global_chunks": global_chunks, "padded_attempts": padded_attempts, "unmatched_merge": unmatched_merge, "hit_chains": hit_chains,
    "insertion_points": insertion_points, "suffix_ranks": suffix_ranks, "seed_hits": seed_hits, "first_purchase": first_purchase,
    "mate_select": mate_select, "mapping_errors": mapping_errors, "active_reads": active_reads, "pileup": pileup, "called_lines": called_lines,
    "call_mutations": call_mutations, "mapped_reads": mapped_reads, "map_order": map_order,
    "chain_counts": chain_counts, "chain_stream": chain_stream, "call_indels": call_indels, "mapped_indels": mapped_indels,
    "map_order_chunks": map_order_chunks, "alignment_views": alignment_views, "long_insertion_points": long_insertion_points,
    "suffix_ranges": suffix_ranges, "all_mappings": all_mappings, "text_forms": text_forms, "mutation_forms": mutation_forms, "pair_forms": pair_forms, "distinct_mutations": distinct_mutations,
}

SEQ = "translate(regexp_replace(lower(text), '[^a-z]', '', 'g'), 'abcdefghijklmnopqrstuvwxyz', 'ACGTACGTACGTACGTACGTACGTAC')"
REFS = f"refs AS (SELECT doc_id AS ref_id, {SEQ} AS seq FROM documents), items AS (SELECT item_id, {SEQ} AS seq FROM benchmark)"
def hits_sql(name: str, patterns: str, k: int) -> str:
    """A table of all places of ``patterns`` (item_id, t, pat) in the documents; patterns under ``k`` bases are tried everywhere."""
    return (
        f"{name}_k AS (SELECT ref_id, seq AS ref, pos::INT AS pos, substr(seq, pos::INT + 1, {k}) AS kmer FROM refs, unnest(range(greatest(length(seq) - {k} + 1, 0))) AS u(pos)), "
        f"{name} AS (SELECT ref_id, item_id, t, pos, length(pat) AS len FROM {name}_k JOIN {patterns} ON kmer = substr(pat, 1, {k}) AND length(pat) >= {k} AND substr(ref, pos + 1, length(pat)) = pat "
        f"UNION ALL SELECT ref_id, item_id, t, pos::INT, length(pat) FROM refs, (SELECT * FROM {patterns} WHERE length(pat) BETWEEN 1 AND {k - 1}), unnest(range(greatest(length(seq) - length(pat) + 1, 0))) AS u(pos) WHERE substr(seq, pos::INT + 1, length(pat)) = pat)"
    )


FOUND = f"{REFS}, whole AS (SELECT item_id, 0 AS t, seq AS pat FROM items), {hits_sql('found', 'whole', 24)}"
TURNS = "t AS (SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS rec, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations)"
TILE_HITS = f"{REFS}, cut AS (SELECT item_id, t::INT AS t, substr(seq, t::INT * (length(seq) // 3) + 1, CASE WHEN t = 2 THEN length(seq) ELSE length(seq) // 3 END) AS pat FROM items, range(3) AS x(t)), {hits_sql('h', 'cut', 12)}"
LINES = "c AS (SELECT l_orderkey, l_linenumber AS n, l_partkey AS x, l_suppkey AS y, CASE WHEN l_quantity > 25 THEN l_linenumber * 10 ELSE -1 END AS p, l_returnflag || l_linestatus AS t FROM lineitem)"
CUT = "a AS (SELECT item_id, seq, p::INT AS padding, d::INT AS div, k, length(seq) - p AS body, (length(seq) - p) // d AS step FROM items, range(11) AS x(p), divs WHERE length(seq) - p >= d), b AS (SELECT *, ceil(body / step)::INT AS cnt FROM a), c AS (SELECT *, CASE WHEN body - (cnt - 1) * step < 8 AND cnt > 1 THEN cnt - 2 ELSE cnt - 1 END AS fin FROM b)"
TILE = "substr(seq, CASE WHEN i = 0 THEN 1 ELSE padding + i * step + 1 END, CASE WHEN i = fin THEN length(seq) ELSE (CASE WHEN i = 0 THEN padding ELSE 0 END) + step END)"
ORDERS = (
    "r AS (SELECT o_custkey AS ref_id, o_orderkey AS read_idx, (o_orderkey * 7 % 40)::INT AS position, translate(regexp_replace(lower(o_orderpriority || o_orderstatus || 'thequickbrownfox'), '[^a-z]', '', 'g'), 'abcdefghijklmnopqrstuvwxyz', 'ACGTACGTACGTACGTACGTACGTAC') AS seq FROM orders), "
    "e AS (SELECT read_idx, position + l_linenumber * 3 AS spot, l_partkey, CASE l_returnflag WHEN 'R' THEN 'S' WHEN 'A' THEN 'D' ELSE 'I' END AS type, (l_partkey % 3)::INT AS len, row_number() OVER (PARTITION BY read_idx, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END ORDER BY l_linenumber, l_partkey, CASE l_returnflag WHEN 'A' THEN 'D' ELSE 'I' END) AS turn FROM lineitem JOIN r ON l_orderkey = read_idx)"
)
SPANS = f"WITH {REFS}, {ORDERS}, adj AS (SELECT read_idx, sum(CASE type WHEN 'D' THEN len WHEN 'I' THEN -len ELSE 0 END) AS n FROM e GROUP BY 1), m AS (SELECT ref_id, read_idx, position AS start, CASE WHEN coalesce(n, 0) + length(r.seq) <= 0 THEN length(refs.seq) ELSE position + coalesce(n, 0) + length(r.seq) END AS stop, length(refs.seq) AS ref_length, r.seq AS seq FROM r JOIN refs USING (ref_id) LEFT JOIN adj USING (read_idx))"
VOTES = (
    f"{SPANS}, g AS (SELECT read_idx, spot, type, len, turn, sum(CASE type WHEN 'D' THEN len ELSE 0 END) OVER (PARTITION BY read_idx ORDER BY turn) AS shift FROM e WHERE type <> 'S'), "
    "x AS (SELECT read_idx, type, turn, shift, CASE type WHEN 'I' THEN spot - 1 ELSE spot END + i AS position FROM g, unnest(range(len)) AS u(i)), "
    "y AS (SELECT x.*, m.seq, m.start, position - start + shift + 1 AS off FROM x JOIN m USING (read_idx) QUALIFY row_number() OVER (PARTITION BY read_idx, position ORDER BY turn) = 1), "
    "v AS (SELECT read_idx, position, type, CASE WHEN type = 'I' THEN substr(seq, (off + 1)::INT, 1) END AS new_base, 0 AS kind FROM y WHERE type = 'D' OR off BETWEEN 0 AND length(seq) - 1 UNION ALL SELECT read_idx, spot, 'S', substr('ACGT', (spot % 4 + 1)::INT, 1), 1 FROM e WHERE type = 'S'), "
    "votes AS (SELECT ref_id, read_idx, position::INT AS position, type, new_base, kind, start FROM v JOIN m USING (read_idx) WHERE position >= start AND position < stop AND position < ref_length AND position >= 0)"
)
PLANTED = "refs AS (SELECT o_custkey AS ref_id, string_agg(translate(md5(o_orderkey::VARCHAR), '0123456789abcdef', 'ACGTACGTACGTACGT'), '' ORDER BY o_orderkey) AS seq FROM orders GROUP BY 1), p AS (SELECT ref_id, seq, k::INT AS k, ref_id * 3 + k AS pair, length(seq) >= 64 AND k < 2 AS changed, translate(substr(seq, 31, 1), 'ACGT', 'GTAC') AS other FROM refs, range(3) AS x(k))"
CHAINS = f"{TILE_HITS}, k AS (SELECT DISTINCT ref_id, item_id FROM h), c AS (SELECT ref_id, item_id, a.pos AS a, b.pos AS b, c.pos AS c, coalesce(b.pos - a.pos BETWEEN 1 AND 1000, true) AND coalesce(c.pos - coalesce(b.pos, a.pos) BETWEEN 1 AND 1000, true) AS ok FROM k LEFT JOIN (SELECT * FROM h WHERE t = 0) a USING (ref_id, item_id) LEFT JOIN (SELECT * FROM h WHERE t = 1) b USING (ref_id, item_id) LEFT JOIN (SELECT * FROM h WHERE t = 2) c USING (ref_id, item_id))"
EDITED = (
    "refs AS (SELECT o_custkey AS ref_id, string_agg(translate(md5(o_orderkey::VARCHAR), '0123456789abcdef', 'ACGTACGTACGTACGT'), '' ORDER BY o_orderkey) AS seq FROM orders GROUP BY 1), "
    "n AS (SELECT *, CASE WHEN translate(substr(seq, 31, 1), 'ACGT', 'CGTA') != substr(seq, 30, 1) THEN translate(substr(seq, 31, 1), 'ACGT', 'CGTA') ELSE translate(substr(seq, 31, 1), 'ACGT', 'GTAC') END AS base, "
    "length(seq) >= 64 AND (ref_id % 2 = 1 OR (substr(seq, 30, 1) != substr(seq, 31, 1) AND substr(seq, 31, 1) != substr(seq, 32, 1))) AS good FROM refs), "
    "p AS (SELECT ref_id, seq, base, k::INT AS k, ref_id * 3 + k AS pair, good AND k < 2 AS changed FROM n, range(3) AS x(k))"
)
ORACLE_SQL = {
    "chain_counts": f"WITH {CHAINS} SELECT ref_id, item_id, count(*) FILTER (ok) AS n_chains FROM c GROUP BY ALL",
    "chain_stream": f"WITH {CHAINS} SELECT ref_id, item_id, row_number() OVER (PARTITION BY ref_id, item_id ORDER BY a, b, c) - 1 AS chain_idx, concat_ws(',', coalesce(a, -1), coalesce(b, -1), coalesce(c, -1)) AS chain FROM c WHERE ok",
    "call_indels": f"WITH {EDITED} SELECT DISTINCT ref_id, CASE ref_id % 2 WHEN 0 THEN 30 ELSE 29 END AS position, CASE ref_id % 2 WHEN 0 THEN 'D' ELSE 'I' END AS type, CASE ref_id % 2 WHEN 1 THEN base END AS new_base, 2 AS n FROM p WHERE changed",
    "mapped_indels": f"WITH {EDITED} SELECT pair * 2 AS read_idx, k * 4 AS position, (k * 4)::VARCHAR || ' ' || CASE WHEN changed THEN CASE ref_id % 2 WHEN 0 THEN 'D30:1' ELSE 'I30:1' END ELSE '' END AS line FROM p UNION ALL SELECT pair * 2 + 1, CASE WHEN length(seq) - k * 4 - 60 > 15 THEN k * 4 + 60 END, CASE WHEN length(seq) - k * 4 - 60 > 15 THEN (k * 4 + 60)::VARCHAR || ' ' END FROM p",
    "suffix_ranges": f"WITH {FOUND}, f AS (SELECT item_id, ref_id, count(*) AS n FROM found GROUP BY ALL), b AS (SELECT f.item_id, f.ref_id, n, count(*) FILTER (substr(r.seq, i::INT + 1, 2000) < i2.seq) AS low FROM f JOIN refs AS r USING (ref_id) JOIN items AS i2 USING (item_id), unnest(range(length(r.seq) + 1)) AS u(i) GROUP BY ALL) SELECT ref_id, item_id, low AS left, low + n AS right FROM b",
    "all_mappings": f"WITH {PLANTED} SELECT pair AS read_idx, c AS map_idx, (k * 4 + c * length(seq))::INT AS position, 0 AS errors FROM p, range(2) AS y(c) WHERE length(substr(seq, k * 4 + 1, 50)) > 15",
    "text_forms": f"WITH {ORDERS} SELECT r.read_idx, 'ReadSequence{{read=' || any_value(seq) || ', mapping=Mapping{{pos=' || any_value(position) || ', mis={{' || coalesce(string_agg(substr('ACGT', (spot % 4 + 1)::INT, 1) || '@' || spot, ', ' ORDER BY turn) FILTER (type = 'S'), '') || '}}, indels={{' || coalesce(string_agg('Indel{{' || type || '@' || spot || ', l=' || len || '}}', ', ' ORDER BY turn) FILTER (type <> 'S'), '') || '}}}}}}' AS form FROM r LEFT JOIN (SELECT read_idx, spot, type, len, turn FROM e) AS e USING (read_idx) GROUP BY r.read_idx",
    "mutation_forms": f"{VOTES} SELECT ref_id, read_idx, 'Mutation{{' || CASE type WHEN 'S' THEN 'M' ELSE type END || '@' || position || CASE WHEN type = 'D' THEN '' ELSE ', new=' || new_base END || '}}' AS form FROM votes",
    "distinct_mutations": f"{VOTES} SELECT ref_id, count(DISTINCT (position, type, CASE WHEN type != 'D' THEN new_base END)) AS different, count(*) AS seen FROM votes GROUP BY ref_id",
    "pair_forms": f"WITH {TURNS} SELECT conv_id, rec // 2 AS pair_id, 'ReadPair{{left=' || max(text) FILTER (rec % 2 = 0) || ', right=' || max(text) FILTER (rec % 2 = 1) || '}}' AS form FROM t WHERE rec < n - n % 2 GROUP BY ALL",
    "alignment_views": f"WITH {EDITED}, v AS (SELECT pair, CASE WHEN changed AND ref_id % 2 = 1 THEN substr(seq, k * 4 + 1, 30 - k * 4) || '-' || substr(seq, 31, 19 + k * 4) ELSE substr(seq, k * 4 + 1, CASE WHEN changed THEN 51 ELSE 50 END) END AS top, CASE WHEN NOT changed THEN substr(seq, k * 4 + 1, 50) WHEN ref_id % 2 = 1 THEN substr(seq, k * 4 + 1, 30 - k * 4) || base || substr(seq, 31, 19 + k * 4) ELSE substr(seq, k * 4 + 1, 30 - k * 4) || '-' || substr(seq, 32, 20 + k * 4) END AS low FROM p) SELECT pair AS pair_id, top, low, replace(low, '-', '') AS read, replace(top, '-', '') AS part FROM v",
    "long_insertion_points": "WITH a AS (SELECT s_suppkey, s_acctbal * 20 AS balance, strftime(DATE '1995-01-01' + s_suppkey::INT, '%Y-%m') AS month FROM supplier), o AS (SELECT strftime(o_orderdate, '%Y-%m') AS month, o_totalprice AS price FROM orders) SELECT s_suppkey, count(*) FILTER (price < balance)::INT AS place FROM a JOIN o USING (month) GROUP BY s_suppkey",
    "map_order_chunks": "WITH r AS (SELECT o_orderkey // 256 AS ref_id, 32 * count(*) AS size FROM orders GROUP BY 1), p AS (SELECT ref_id, k, 300 + 1200 * k AS position FROM r, range(2) AS x(k) WHERE size >= 350 + 1200 * k) SELECT row_number() OVER (ORDER BY position, ref_id) - 1 AS rank, ref_id || '-' || k AS label, position::INT AS position FROM p",
    "call_mutations": f"WITH {PLANTED} SELECT DISTINCT ref_id, 30 AS position, 'S' AS type, other AS new_base, 2 AS n FROM p WHERE changed",
    "mapped_reads": f"WITH {PLANTED} SELECT pair * 2 AS read_idx, k * 4 AS position, (k * 4)::VARCHAR || ' ' || CASE WHEN changed THEN 'S30:' || other ELSE '' END AS line FROM p UNION ALL SELECT pair * 2 + 1, CASE WHEN length(seq) - k * 4 - 60 > 15 THEN k * 4 + 60 END, CASE WHEN length(seq) - k * 4 - 60 > 15 THEN (k * 4 + 60)::VARCHAR || ' ' END FROM p",
    "map_order": f"WITH {PLANTED} SELECT row_number() OVER (ORDER BY k, pair) - 1 AS rank, pair::VARCHAR AS label, k * 4 AS position FROM p",
    "padded_attempts": f"WITH {REFS}, divs AS (SELECT 2 AS d, 0 AS k, true AS short UNION ALL SELECT d, d - 3, false FROM range(3, 9) AS y(d)), {CUT.replace('divs WHERE', 'divs WHERE length(seq) > 15 AND short = (length(seq) - p <= 30) AND')}, z AS (SELECT *, 0 AS i FROM c), w AS (SELECT *, fin AS i FROM c) SELECT z.item_id AS read_idx, (z.padding * 10 + z.k)::INT AS attempt, (z.fin + 1)::INT AS n_tiles, {TILE.replace('seq', 'z.seq').replace('padding', 'z.padding').replace('step', 'z.step').replace('fin', 'z.fin').replace('i =', 'z.i =').replace('i *', 'z.i *')} AS first_tile, {TILE.replace('seq', 'w.seq').replace('padding', 'w.padding').replace('step', 'w.step').replace('fin', 'w.fin').replace('i =', 'w.i =').replace('i *', 'w.i *')} AS last_tile FROM z JOIN w ON z.item_id = w.item_id AND z.padding = w.padding AND z.div = w.div",
    "unmatched_merge": f"WITH {LINES}, g AS (SELECT *, sum(CASE WHEN p >= 0 OR coalesce(q, 0) >= 0 THEN 1 ELSE 0 END) OVER (PARTITION BY l_orderkey ORDER BY n, x, y, p, t) AS grp FROM (SELECT *, lag(p) OVER (PARTITION BY l_orderkey ORDER BY n, x, y, p, t) AS q FROM c)), m AS (SELECT l_orderkey, grp, min(p) AS p, string_agg(t, '' ORDER BY n, x, y, p, t) AS t FROM g GROUP BY ALL) SELECT l_orderkey, string_agg(p::VARCHAR, ',' ORDER BY grp) AS places, string_agg(t, ',' ORDER BY grp) AS tiles FROM m GROUP BY 1",
    "hit_chains": f"WITH {LINES} SELECT l_orderkey, string_agg(p::VARCHAR, ',' ORDER BY n, x, y, p, t) AS chain FROM c GROUP BY 1 HAVING max(p) >= 0",
    "insertion_points": "SELECT c_custkey, count(*) FILTER (o_totalprice < c_acctbal)::INT AS place FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey",
    "suffix_ranks": "SELECT c_custkey AS ref_id, row_number() OVER (PARTITION BY c_custkey ORDER BY substr(c_name, i::INT + 1), i) - 1 AS rank, i::INT AS start FROM customer, unnest(range(length(c_name) + 1)) AS u(i)",
    "seed_hits": f"WITH {TILE_HITS} SELECT ref_id, item_id, t AS tile_idx, string_agg(pos::VARCHAR, ',' ORDER BY pos) AS hits FROM h GROUP BY ALL",
    "first_purchase": "WITH p AS (SELECT user_id, hour(ts)::INT AS hour, event_id FROM events WHERE event_type = 'purchase') SELECT * FROM p QUALIFY hour = min(hour) OVER (PARTITION BY user_id)",
    "mate_select": "WITH m AS (SELECT user_id, CASE event_type WHEN 'click' THEN 0 ELSE 1 END AS mate, event_id, floor(epoch_us(ts) / 1000000)::INT AS pos, floor(value)::INT AS gap FROM events WHERE event_type IN ('click', 'purchase')), two AS (SELECT user_id FROM m GROUP BY 1 HAVING count(DISTINCT mate) = 2), b AS (SELECT l.user_id, l.event_id AS l, r.event_id AS r, l.pos AS lp, r.pos AS rp FROM m l JOIN m r ON l.user_id = r.user_id AND l.mate = 0 AND r.mate = 1 AND r.pos > l.pos + l.gap QUALIFY row_number() OVER (PARTITION BY l.user_id ORDER BY r.pos - l.pos - l.gap, l.event_id, r.event_id) = 1) SELECT user_id AS pair_id, 0 AS mate, l AS map_idx, lp AS position FROM b UNION ALL SELECT user_id, 1, r, rp FROM b UNION ALL (SELECT user_id, mate, event_id, pos FROM m WHERE user_id NOT IN (FROM two) QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id) = 1)",
    "mapping_errors": f"WITH {ORDERS} SELECT r.read_idx, (count(*) FILTER (type = 'S') + coalesce(sum(len) FILTER (type <> 'S'), 0))::INT AS errors, coalesce(sum(CASE type WHEN 'D' THEN len WHEN 'I' THEN -len ELSE 0 END), 0)::INT AS adjust, any_value(position)::VARCHAR || ' ' || coalesce(string_agg(type || spot || ':' || CASE type WHEN 'S' THEN substr('ACGT', (spot % 4 + 1)::INT, 1) ELSE len::VARCHAR END, ',' ORDER BY CASE type WHEN 'S' THEN 0 ELSE 1 END, turn), '') AS line FROM r LEFT JOIN e USING (read_idx) GROUP BY r.read_idx",
    "active_reads": f"{SPANS}, d AS (SELECT ref_id, start AS position, 1 AS n FROM m UNION ALL SELECT ref_id, stop, -1 FROM m), c AS (SELECT ref_id, position::INT AS position, sum(n) AS n FROM d GROUP BY ALL) SELECT ref_id, position, (sum(n) OVER (PARTITION BY ref_id ORDER BY position))::BIGINT AS depth FROM c",
    "pileup": f"{VOTES} SELECT ref_id, read_idx, position, type, new_base FROM votes",
    "called_lines": f"{VOTES}, t AS (SELECT ref_id, position, type, new_base, count(*) AS n, min((start, read_idx, kind)) AS first FROM votes GROUP BY ref_id, position, type, new_base QUALIFY row_number() OVER (PARTITION BY ref_id, position ORDER BY count(*) DESC, min((start, read_idx, kind))) = 1), n AS (SELECT t.ref_id, t.position, count(*) AS total FROM t JOIN m ON t.ref_id = m.ref_id AND start <= position AND position < stop GROUP BY ALL) SELECT ref_id, position, '>' || type || position || ' ' || CASE type WHEN 'S' THEN substr(seq, position + 1, 1) || ' ' || new_base WHEN 'I' THEN new_base ELSE substr(seq, position + 1, 1) END AS line FROM t JOIN n USING (ref_id, position) JOIN refs USING (ref_id) WHERE n > total // 2",
    "reference_concat": "SELECT doc_id, array_to_string(list_slice(CASE WHEN text LIKE '%' || chr(10) OR text = '' THEN list_slice(string_split(text, chr(10)), 1, len(string_split(text, chr(10))) - 1) ELSE string_split(text, chr(10)) END, 2, 1000000000), '') AS seq FROM documents",
    "read_pairing": f"WITH {TURNS} SELECT conv_id, rec // 2 AS pair_id, (rec % 2)::INT AS mate, role AS label, text AS seq FROM t WHERE rec < n - n % 2",
    "mean_read_length": f"WITH {TURNS} SELECT (sum(length(text)) // count(*))::BIGINT AS mean_read_length FROM t WHERE rec < n - n % 2",
    "short_read_filter": f"WITH {REFS} SELECT ref_id, length(seq)::INT AS length, CASE WHEN length(seq) <= 30 THEN '2' ELSE '3,4,5,6,7,8' END AS divisions FROM refs WHERE length(seq) > 15",
    "tile_reads": f"WITH {REFS}, divs AS (SELECT d, 0 AS k FROM range(2, 9) AS y(d)), {CUT} SELECT item_id, padding, div, i::INT AS tile_idx, {TILE} AS tile FROM c, unnest(range(fin + 1)) AS u(i)",
    "exact_find": f"WITH {FOUND} SELECT ref_id, item_id, pos FROM found",
    "coverage_depth": f"WITH {FOUND}, e AS (SELECT ref_id, pos AS position, 1 AS n FROM found UNION ALL SELECT ref_id, pos + len, -1 FROM found), c AS (SELECT ref_id, position::INT AS position, sum(n) AS n FROM e GROUP BY ALL) SELECT ref_id, position, (sum(n) OVER (PARTITION BY ref_id ORDER BY position))::BIGINT AS depth FROM c",
    "mean_coverage": f"WITH {FOUND} SELECT r.ref_id, coalesce(c.n, 0)::DOUBLE / length(seq) AS mean_coverage FROM refs r LEFT JOIN (SELECT ref_id, sum(len) AS n FROM found GROUP BY 1) c USING (ref_id) WHERE length(seq) > 0",
    "mapping_rate": f"WITH {FOUND} SELECT count(*) FILTER (item_id IN (SELECT item_id FROM found)) AS mapped, count(*) AS reads FROM items",
    "mapping_order": f"WITH {FOUND}, f AS (SELECT item_id, min(pos)::INT AS position FROM found GROUP BY 1) SELECT row_number() OVER (ORDER BY position NULLS LAST, item_id) - 1 AS rank, item_id, position FROM items LEFT JOIN f USING (item_id)",
    "increasing_chains": f"WITH {TILE_HITS}, k AS (SELECT DISTINCT ref_id, item_id FROM h), c AS (SELECT ref_id, item_id, a.pos AS a, b.pos AS b, c.pos AS c FROM k LEFT JOIN (SELECT * FROM h WHERE t = 0) a USING (ref_id, item_id) LEFT JOIN (SELECT * FROM h WHERE t = 1) b USING (ref_id, item_id) LEFT JOIN (SELECT * FROM h WHERE t = 2) c USING (ref_id, item_id)) SELECT ref_id, item_id, concat_ws(',', a, b, c) AS chain FROM c WHERE coalesce(b - a BETWEEN 1 AND 1000, true) AND coalesce(c - coalesce(b, a) BETWEEN 1 AND 1000, true)",
    "pair_select": "WITH b AS (SELECT l.user_id, l.event_id AS left_order, r.event_id AS right_order, epoch_us(r.ts) - epoch_us(l.ts) AS distance FROM events l JOIN events r ON l.user_id = r.user_id AND l.event_type = 'click' AND r.event_type = 'purchase' AND r.ts > l.ts) SELECT user_id, left_order, right_order, distance FROM b QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY distance, left_order, right_order) = 1",
    "majority_call": "WITH c AS (SELECT user_id, hour(ts)::INT AS hour, event_type, count(*) AS n, min(event_id) AS first, sum(count(*)) OVER (PARTITION BY user_id, hour(ts)) AS total FROM events GROUP BY user_id, hour(ts), event_type) SELECT user_id, hour, event_type, n FROM c WHERE n > total // 2",
    "global_chunks": f"WITH {TURNS}, w AS (SELECT (100000 - 2 * coalesce(sum(length(text)) // count(*), 0))::INT AS step FROM t WHERE rec < n - n % 2), d AS (SELECT doc_id, length(text) AS size, CASE WHEN length(text) <= 100000 THEN [0] ELSE range(0, length(text), step) END AS lefts FROM documents, w WHERE text IS NOT NULL) SELECT doc_id, i::INT AS left, least(i + 100000, size)::INT AS right FROM d, unnest(lefts) AS u(i)",
}
