"""Mixing sources to target weights by pivotal dependent rounding. DataFrame and SQL functions only.

A source's documents share one expected number of copies, target / source size. The whole part is taken outright; the
fractional parts are rounded in pairs: mass (words) moves between two documents, in a random direction with the
probabilities that keep both expectations, until one of them is at none or all of its copy. The other carries the
residual on. Blocks of about `fan_in` documents are folded this way, their residuals meet in blocks of the next level,
and so on up a reduction tree; the source's words stay exactly constant throughout. The one residual left at a source's
root is taken as that fraction of the document's leading words (residual="partial") or rounded (residual="round").
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, carried, running, written

WEIGHTS = (5, 2, 1)
MAX_COPIES = 3
#: Up to so many sources (rows of about 60 bytes) the table of targets is broadcast; beyond, joined by shuffle.
BROADCAST_SOURCES = 20_000
#: Of rows alike in identifier, source and size so many are numbered by one task.
ALIKE_ROWS = 100_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_copies: int = MAX_COPIES) -> DataFrame:
    """(source, source_size, target, copies): weights repeat over sources by code point, null last; no target exceeds
    max_copies times its source, and what is cut goes to the others by weight (water filling, in closed form over the
    sources sorted by cap / weight)."""
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = running(sizes.withColumn("_one", F.lit(1).cast("long")), [F.asc_nulls_last("source")], {"_rank": "_one"})
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod("_rank", F.lit(len(weights))) + 1).cast("int"))
    capped = ranked.select("source", "source_size", weight.alias("_w"), (F.col("source_size") * float(max_copies)).alias("_cap"))
    capped = capped.withColumn("_ratio", F.col("_cap") / F.col("_w"))
    filled = written(running(capped, [F.asc("_ratio"), F.asc_nulls_last("source")], {"_caps": "_cap", "_ws": "_w"}), "targets")
    total, weight_sum = filled.agg(F.sum("source_size"), F.sum("_w")).first()
    level = 0.0
    if total:
        share = (F.lit(float(total)) - F.col("_caps")) / F.greatest(F.lit(float(weight_sum)) - F.col("_ws"), F.lit(1e-9))
        row = filled.select("_ratio", "_ws", share.alias("_share")).filter("_share <= _ratio").agg(F.min_by("_share", "_ws")).first()
        level = row[0] if row[0] is not None else float("inf")
    target = F.least(F.col("_cap"), F.col("_w") * F.lit(level)) if total else F.lit(0.0)
    return filled.select("source", "source_size", target.alias("target")).withColumn("copies", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))


def _fold(seed: int) -> str:
    """Folds docs: array<struct<w, id, no, m>>, 0 < m < w mostly, to struct<r: the residual, out: the decided ones>."""
    up = "least(s.r.w - s.r.m, b.m)"
    down = "least(s.r.m, b.w - b.m)"
    u = f"(pmod(xxhash64(s.r.id, b.id, s.r.w, b.w, s.r.no, b.no, {seed}L), 9007199254740992L) / 9007199254740992D)"
    gains = f"{u} * ({up} + {down}) < {down}"
    a = f"CASE WHEN {gains} THEN if({up} = s.r.w - s.r.m, cast(s.r.w AS double), s.r.m + {up}) ELSE if({down} = s.r.m, 0D, s.r.m - {down}) END"
    b = f"CASE WHEN {gains} THEN if({up} = b.m, 0D, b.m - {up}) ELSE if({down} = b.w - b.m, cast(b.w AS double), b.m + {down}) END"
    pair = f"named_struct('a', named_struct('w', s.r.w, 'id', s.r.id, 'no', s.r.no, 'm', {a}), 'b', named_struct('w', b.w, 'id', b.id, 'no', b.no, 'm', {b}), 'out', s.out)"
    # (pair -> state) as a one-element transform, which stands for a local variable
    step = f"element_at(transform(array({pair}), p -> if(p.a.m = 0D OR p.a.m = p.a.w, named_struct('r', p.b, 'out', concat(p.out, array(p.a))), named_struct('r', p.a, 'out', concat(p.out, array(p.b))))), 1)"
    return f"aggregate(slice(docs, 2, greatest(size(docs) - 1, 0)), named_struct('r', element_at(docs, 1), 'out', slice(docs, 1, 0)), (s, b) -> {step})"


def told_apart(sized: DataFrame) -> DataFrame:
    """sized (id, source, size) with `no`, which tells rows alike in all three apart. They are summed to one row before
    the shuffle and dealt out again, ALIKE_ROWS to a task, so an identifier that many rows repeat is no hot key."""
    counts = sized.groupBy("id", "source", "size").agg(F.count("*").alias("_rows"))
    parts = counts.withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_rows") - 1) / ALIKE_ROWS))))
    few, many = parts.filter(F.col("_rows") <= ALIKE_ROWS), parts.filter(F.col("_rows") > ALIKE_ROWS).repartition("id", "source", "size", "_part")
    last = F.least(F.col("_rows"), (F.col("_part") + 1) * ALIKE_ROWS) - 1
    return few.unionByName(many).select("id", "source", "size", F.explode(F.sequence(F.col("_part") * ALIKE_ROWS, last)).alias("no"))


def mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, max_copies: int = MAX_COPIES, seed: int = 7, fan_in: int = 64, residual: str = "partial") -> DataFrame:
    """One row per row of df: id_col, size, source_size, target, taken (and source).

    Null texts have size 0 and give nothing; a null source is a source of its own, last in order. Repeated rows count as
    documents of their own; those alike in identifier and size are interchangeable. Reruns agree: every draw is a hash
    of the two documents and the seed. An empty table gives an empty result; other columns are not read.
    """
    sized = written(df.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size")), "sizes")
    goals = written(targets(sized, weights, max_copies), "goals")
    n_docs, n_sources = sized.count(), goals.count()
    sized = written(told_apart(sized), "rows")
    small = F.broadcast(goals) if n_sources <= BROADCAST_SOURCES else goals
    small = small.withColumnRenamed("source", "_s")
    docs = sized.join(small, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    docs = docs.withColumn("base", F.floor("copies")).withColumn("m", (F.col("copies") - F.col("base")) * F.col("size"))
    fixed = ["source", "source_size", "target", "base"]
    blocks = max(1, -(-n_docs // fan_in))
    level = docs.filter("m > 0").select(*fixed, F.pmod(F.xxhash64("id", "size", "no", F.lit(seed)), F.lit(blocks)).alias("block"), F.struct(F.col("size").alias("w"), "id", "no", "m").alias("d"))
    parts = [docs.filter("NOT m > 0").select("id", "size", *fixed, F.lit(0.0).alias("m"))]
    while True:
        folded = level.groupBy(*fixed, "block").agg(F.sort_array(F.collect_list("d"), asc=False).alias("docs"))
        folded = written(folded.select(*fixed, "block", F.expr(_fold(seed)).alias("f")).select(*fixed, "block", "f.r", "f.out"), "level")
        parts.append(folded.select(*fixed, F.explode("out").alias("d")).select(F.col("d.id").alias("id"), F.col("d.w").alias("size"), *fixed, F.col("d.m").alias("m")))
        if blocks == 1:
            break
        blocks = -(-blocks // fan_in)
        level = folded.select(*fixed, F.floor(F.col("block") / fan_in).alias("block"), F.col("r").alias("d"))
    last = F.col("r.m") if residual == "partial" else F.round(F.col("r.m") / F.col("r.w")) * F.col("r.w")
    parts.append(folded.select(F.col("r.id").alias("id"), F.col("r.w").alias("size"), *fixed, last.alias("m")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    taken = (F.col("base") * F.col("size") + F.round("m")).cast("long")
    return out.select(F.col("id").alias(id_col), "size", "source_size", "target", taken.alias("taken"), F.col("source").alias(source_col))


def numbered(rows: DataFrame, keys: list[str], last: str) -> DataFrame:
    """rows with `_no`, each one's number among those of equal keys, in the order of `last`. Whatever rows share a key,
    they are spread over all tasks: numbers come from running sums over sorted partitions, less the key's first."""
    rows = running(rows.withColumn("_one", F.lit(1).cast("long")), [*[F.asc_nulls_last(k) for k in keys], F.asc_nulls_last(last)], {"_nr": "_one"}).drop("_one")
    rows = written(rows, "numbered")
    first = rows.groupBy(*keys).agg(F.min("_nr").alias("_first"))
    first = first.select(*[F.col(k).alias(f"_f{k}") for k in keys], "_first")
    match = F.lit(True)
    for k in keys:
        match = match & F.col(k).eqNullSafe(F.col(f"_f{k}"))
    return rows.join(first, match).withColumn("_no", F.col("_nr") - F.col("_first")).drop("_nr", "_first", *[f"_f{k}" for k in keys])


def mixed_documents(df: DataFrame, **options) -> DataFrame:
    """df's rows as often as the mix takes them, each source's one partial document cut after its taken words; df's own columns.

    A document taken taken = q * size + rest words is repeated q times, and once more with its first `rest` words.
    Null, empty and blank texts have no words and do not come. Rows with null identifiers or sources count as mix() says;
    of rows alike in identifier, source and size, texts in order are matched with the plan's rows, the least taken first.
    An empty table gives an empty one.
    """
    id_col, text_col = options.get("id_col", "doc_id"), options.get("text_col", "text")
    source_col = options.get("source_col", "source")
    plan = mix(df, **options).select(F.col(id_col).alias("_id"), F.col(source_col).alias("_source"), F.col("size").alias("_size"), F.col("taken").alias("_taken"))
    docs = carried(df, _own_id=F.col(id_col), _own_source=F.col(source_col), _text=F.col(text_col), _own=word_count(F.col(text_col)))
    same = F.col("_own_id").eqNullSafe(F.col("_id")) & F.col("_own_source").eqNullSafe(F.col("_source")) & (F.col("_own") == F.col("_size"))
    alike = written(plan.groupBy("_id", "_source", "_size").agg(F.count("*").alias("_rows")).filter("_rows > 1"), "alike")
    if alike.isEmpty():
        both = docs.join(plan.filter("_taken > 0"), same)
    else:  # rows alike in identifier, source and size are numbered and matched one to one with the plan's
        key = ["_id", "_source", "_size"]
        hashed = F.xxhash64(*key)
        docs, plan = docs.withColumn("_key", F.xxhash64("_own_id", "_own_source", "_own")), plan.withColumn("_key", hashed)
        many = alike.select(hashed.alias("_key")).distinct()
        one = docs.join(many, "_key", "left_anti").join(plan.join(many, "_key", "left_anti").filter("_taken > 0").drop("_key"), same).drop("_key")
        mine = numbered(docs.join(many, "_key", "left_semi"), ["_key", "_own_id", "_own_source", "_own"], "_text")
        theirs = numbered(plan.join(many, "_key", "left_semi"), ["_key", *key], "_taken").filter("_taken > 0").drop("_key")
        both = one.unionByName(mine.join(theirs.withColumnRenamed("_no", "_nth"), same & (F.col("_no") == F.col("_nth"))).select(*one.columns))
    both = both.withColumn("_full", F.floor(F.col("_taken") / F.col("_size"))).withColumn("_rest", F.col("_taken") - F.col("_full") * F.col("_size"))
    copies = both.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_full") + F.when(F.col("_rest") > 0, 1).otherwise(0))))
    head = F.regexp_extract("_text", r"^[\x20\x09-\x0D]*", 0)
    words = F.expr("regexp_extract_all(_text, '[^\\\\x20\\\\x09-\\\\x0D]+[\\\\x20\\\\x09-\\\\x0D]*', 0)")
    cut = F.concat(head, F.array_join(F.slice(words, F.lit(1), F.col("_rest").cast("int")), ""))
    text = F.when(F.col("_copy") <= F.col("_full"), F.col("_text")).otherwise(cut)
    return copies.select(*[text.alias(c) if c == text_col else F.col(f"_row.`{c}`").alias(c) for c in df.columns])
