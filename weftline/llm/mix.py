"""Mixing sources to target shares of all tokens.

The largest mix is taken in which every source can hold its share without
repeating a text more than its cap allows. Each source's texts are shuffled
pass by pass and cut into blocks of equal tokens; a low-discrepancy schedule
(multiples of the golden ratio, mapped through the cumulative shares) says
which source's next block fills each slot, so every stretch of the mix is near
its targets. Prefix sums are two-level (buckets, then rows within a bucket):
no window ever holds a whole source.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import stage
from .tokens import count_tokens

BLOCK_TOKENS = 4096
#: Slots whose ranks are counted together, and cells of the unit interval in which a slot looks for its source.
CHUNK, CELLS = 4096, 4096
#: A source's uses are summed in so many buckets a pass, by the top bits of a hash.
BUCKET_BITS = 10
GOLDEN = 0.6180339887498949


def sized_texts(documents: DataFrame) -> DataFrame:
    """(source, doc_id, n_tokens) of the distinct non-empty texts of ``documents``, by the first document of each.

    Equal texts are one text wherever they stand; it belongs to the first of
    its sources by name, so no source can repeat it beyond its own cap.
    """
    key = F.unhex(F.substring(F.sha2("text", 256), 1, 32))
    rows = documents.where("text is not null and text != ''").select("doc_id", F.coalesce("source", F.lit("")).alias("source"), key.alias("h"), "text")
    sized = count_tokens(rows)
    return sized.groupBy("h").agg(F.min(F.struct("source", "doc_id")).alias("d"), F.first("n_tokens").alias("n_tokens")).select("d.source", "d.doc_id", "n_tokens").where("n_tokens > 0")


QUOTAS = "source string, share double, quota double, total long, passes int"


def plan(texts: DataFrame, targets: DataFrame) -> DataFrame:
    """Quota of each source: rows (source, share, quota, total, passes).

    Targets with a null or non-positive share, and unlisted sources, take no
    part; a listed source without texts leaves its share to the others in
    proportion. A null cap counts as 1.
    """
    wanted = targets.where("source is not null and target_share > 0").groupBy("source").agg(F.max("target_share").alias("share"), F.coalesce(F.max("max_repeats"), F.lit(1)).alias("cap"))
    totals = texts.groupBy("source").agg(F.sum("n_tokens").alias("total"))
    rows = stage(wanted.join(totals, "source").where("cap > 0 and total > 0"))
    all_ = rows.agg(F.sum("share").alias("scale"), F.min(F.col("total") * F.col("cap") / F.col("share")).alias("size")).first()
    scale, size = all_["scale"] or 1.0, (all_["size"] or 0.0) * (all_["scale"] or 1.0)
    quota = F.lit(size) * F.col("share") / F.lit(scale)
    out = rows.select("source", (F.col("share") / F.lit(scale)).alias("share"), quota.alias("quota"), F.col("total").cast("long").alias("total"), "cap")
    return out.select("source", "share", "quota", "total", F.least("cap", F.ceil(F.col("quota") / F.col("total"))).cast("int").alias("passes"))


def placed(texts: DataFrame, quotas: DataFrame) -> DataFrame:
    """(source, doc_id, pass, n_tokens, block): each use of a text with the block of its source it lies in."""
    # One row per source of the targets; the plan broadcasts it where it sees that it is small.
    uses = texts.join(quotas, "source").select("source", "doc_id", "n_tokens", "quota", F.explode(F.sequence(F.lit(1), F.col("passes"))).alias("pass"))
    h = F.xxhash64("doc_id", "pass", "source")
    uses = uses.withColumn("h", h).withColumn("bucket", F.shiftrightunsigned(F.col("h"), 64 - BUCKET_BITS))
    # Buckets are the top bits of the hash, unsigned; compare the rest in the same order.
    sums = uses.groupBy("source", "pass", "bucket").agg(F.sum("n_tokens").alias("s"))
    before = sums.select("source", "pass", "bucket", F.expr("coalesce(sum(s) over (partition by source order by pass, bucket rows between unbounded preceding and 1 preceding), 0)").alias("skip"))
    inner = F.expr("sum(n_tokens) over (partition by source, pass, bucket order by h, doc_id rows between unbounded preceding and current row)") - F.col("n_tokens")
    at = uses.withColumn("inner", inner).join(before, ["source", "pass", "bucket"]).withColumn("at", F.col("skip") + F.col("inner"))
    kept = at.where(F.col("at") + F.col("n_tokens") / 2 <= F.col("quota"))
    return kept.select("source", "doc_id", "pass", "n_tokens", F.floor(F.col("at") / BLOCK_TOKENS).alias("block"))


def schedule(quotas: DataFrame | list[dict], spark: SparkSession) -> DataFrame:
    """(slot, source, block): the golden-ratio schedule of all blocks; the few that found no slot stand at the end.

    ``quotas`` has a row per source with share and quota. A slot's point finds
    its source's stretch of the unit interval by an equi-join on cells, which
    hold equally many points each.
    """
    if not isinstance(quotas, DataFrame):
        quotas = spark.createDataFrame([(q["source"], q["share"], q["quota"]) for q in quotas], "source string, share double, quota double")
    q = quotas.select("source", "share", (F.floor(F.col("quota") / BLOCK_TOKENS) + 1).alias("blocks"))
    # One row per source: cumulative shares in order of source; the last stretch reaches beyond 1.
    q = q.select("source", "blocks", F.expr("coalesce(sum(share) over (partition by 1 order by source rows between unbounded preceding and 1 preceding), 0D)").alias("low"), F.expr("lead(source) over (partition by 1 order by source)").alias("next"), "share")
    q = stage(q.select("source", "blocks", "low", F.when(F.col("next").isNull(), 2.0).otherwise(F.col("low") + F.col("share")).alias("high")))
    facts = q.agg(F.sum("blocks").alias("blocks"), F.count(F.lit(1)).alias("sources")).first()
    n, cells = int((facts["blocks"] or 0) * 1.05) + 2000, CELLS + facts["sources"]
    cell = lambda c: F.floor(F.least(c, F.lit(1 - 1e-12)) * cells)
    stretches = q.select("source", "blocks", "low", "high", F.explode(F.sequence(cell(F.col("low")), cell(F.col("high")))).alias("cell"))
    slots = spark.range(n).withColumn("u", F.expr(f"(id + 0.5D) * {GOLDEN}D % 1")).withColumn("cell", cell(F.col("u")))
    slots = slots.join(stretches, "cell").where("u >= low and u < high").select("id", "source", "blocks", F.floor(F.col("id") / CHUNK).alias("chunk"))
    counts = slots.groupBy("source", "chunk").agg(F.count(F.lit(1)).alias("n"))
    before = counts.select("source", "chunk", F.expr("coalesce(sum(n) over (partition by source order by chunk rows between unbounded preceding and 1 preceding), 0)").alias("skip"))
    inner = F.expr("row_number() over (partition by source, chunk order by id)") - 1
    ranked = slots.withColumn("inner", inner).join(before, ["source", "chunk"]).select(F.col("id").alias("slot"), "source", "blocks", (F.col("skip") + F.col("inner")).alias("block"))
    found = ranked.where("block < blocks").select("slot", "source", "block")
    got = counts.groupBy("source").agg(F.sum("n").alias("got"))
    # Blocks without a slot: at most a few, of sources with very small shares.
    missing = q.join(got, "source", "left").where("coalesce(got, 0) < blocks").select("source", F.explode(F.sequence(F.coalesce("got", F.lit(0)), F.col("blocks") - 1)).alias("block"))
    late = missing.select((F.expr("row_number() over (partition by 1 order by block, source)") + F.lit(n - 1)).cast("long").alias("slot"), "source", "block")
    return found.unionByName(late)


MIX = "slot long, source string, doc_id long, pass int, n_tokens long"


def mixed(documents: DataFrame, targets: DataFrame) -> DataFrame:
    """(slot, source, doc_id, pass, n_tokens): the mix; texts of one slot stand together, slots follow in order.

    ``pass`` counts a text's uses from 1. Without targets or texts the mix is
    empty. Null and empty texts and texts without source in the targets take
    no part.
    """
    spark = documents.sparkSession
    texts = stage(sized_texts(documents))
    quotas = stage(plan(texts, targets))
    if quotas.isEmpty():
        return spark.createDataFrame([], MIX)
    uses = placed(texts, quotas.select("source", "quota", "passes"))
    slots = schedule(quotas, spark)
    return uses.join(slots, ["source", "block"]).select("slot", "source", "doc_id", F.col("pass").cast("int").alias("pass"), "n_tokens")


def shares(documents: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target_share, tokens, share, texts, most_uses): what each source reached; unlisted sources have target 0."""
    mix = stage(mixed(documents, targets))
    per_text = mix.groupBy("source", "doc_id").agg(F.count(F.lit(1)).alias("uses"), F.sum("n_tokens").alias("tokens"))
    got = per_text.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("texts"), F.max("uses").alias("most_uses"))
    # A few rows, one per source.
    got = got.withColumn("all", F.expr("sum(tokens) over (partition by 1)"))
    names = targets.where("source is not null").groupBy("source").agg(F.max("target_share").alias("target_share"))
    names = names.join(documents.select(F.coalesce("source", F.lit("")).alias("source")).distinct(), "source", "full").select("source", F.coalesce("target_share", F.lit(0.0)).alias("target_share"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return names.join(got, "source", "left").select("source", "target_share", zero("tokens"), F.round(F.coalesce(F.col("tokens") / F.col("all"), F.lit(0.0)), 6).alias("share"), zero("texts"), zero("most_uses"))
