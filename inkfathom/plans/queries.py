"""The style engine as queries over the driver's tables, each beside its SQL.

The tables' text has next to none of the words the engine looks for, so most queries read it with a phrase added by
doc_id, the same in both. Sources stand for authors and larger doc_ids for newer samples.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import lexicon as lx
from ..functions import text as tx
from ..operators import profile, rewrite
from ..sources import store
from ..sources.shared import scratch, written

SEEDS = (
    "",
    " However, I'm sure it's fine. We don't utilize it, but they were invited; honestly, pretty much super stuff! Isn't it?",
    " In order to obtain numerous additional results, individuals demonstrate that it is important to note that robust things fail. Therefore we commence -- prior to lunch.",
    " In today's fast-paced world, we delve into a testament to synergy. It is worth noting that I am here and you are not. They will not assist; it is literally a lot of work.",
    "  As a result , he was taken and the road was broken by rain but we kept on and they would not stop because it is about time so we start .e.g. this",
    " I came. I saw. I won. you know like,x gonna wanna — that said. Why? Still, we can't. café isn’t it",
)


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents; dealt to all cores where the table has fewer splits than those (small files), as the rules cost
    far more than the shuffle. Large tables are read as they are."""
    t, cores = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.sparkContext.defaultParallelism
    return t if t.rdd.getNumPartitions() >= cores else t.repartition(cores)


def _seeded(spark: SparkSession, sf_dir: str) -> DataFrame:
    seed = F.element_at(F.array(*[F.lit(s) for s in SEEDS]), (F.pmod("doc_id", F.lit(len(SEEDS))) + 1).cast("int"))
    return _docs(spark, sf_dir).select("doc_id", "source", "lang", F.concat(F.coalesce("text", F.lit("")), seed).alias("text"))


# --- SQL pieces ---
D = f"d AS (SELECT doc_id, source, lang, coalesce(text, '') || ([{', '.join(map(q, SEEDS))}])[doc_id % {len(SEEDS)} + 1] AS text FROM documents)"


def sql_trim(t: str) -> str:
    return f"regexp_replace({t}, '^[{tx.WS}]+|[{tx.WS}]+$', '', 'g')"


def sql_words(t: str) -> str:
    return f"list_filter(string_split_regex(regexp_replace(lower({t}), '[^a-z0-9''{tx.WS}-]', ' ', 'g'), '[{tx.WS}]+'), lambda x: x <> '')"


def sql_word_count(t: str) -> str:
    return f"len(list_filter(string_split_regex({sql_trim(t)}, '[{tx.WS}]+'), lambda x: x <> ''))::BIGINT"


def sql_sentences(t: str) -> str:
    cut = f"string_split(regexp_replace({t}, '([.!?])[{tx.WS}]+', '\\1' || chr(1), 'g'), chr(1))"
    return f"list_filter(list_transform({cut}, lambda x: {sql_trim('x')}), lambda x: x <> '')"


def sql_kept(t: str) -> str:
    parts = f"regexp_extract_all({t}, '[^.!?]+[.!?]+|[^.!?]+$')"
    return f"CASE WHEN len({parts}) = 0 THEN [{sql_trim(t)}] ELSE list_filter(list_transform({parts}, lambda x: {sql_trim('x')}), lambda x: x <> '') END"


def sql_round(x: str, places: int = 0) -> str:
    return f"floor(({x}) * {10**places}::DOUBLE + 0.5) / {10**places}::DOUBLE"


def sql_count(t: str, pattern: str) -> str:
    return f"len(regexp_extract_all({t}, {q(pattern)}))::BIGINT"


def sql_terms(terms: list[str]) -> str:
    return "(?i)\\b(?:" + "|".join(terms) + ")\\b"


SQL_COUNTS = {
    "contractions": sql_terms(lx.CONTRACTIONS),
    "questions": "\\?",
    "exclamations": "!",
    "commas": ",",
    "semicolons": ";",
    "dashes": "—|--",
    "first_person": sql_terms(lx.FIRST_PERSON),
    "passives": rf"(?i)\b(?:{'|'.join(lx.BE_FORMS)})[{tx.WS}]+[A-Za-z0-9_]+(?:ed|en)\b",
    "formal": sql_terms(lx.FORMAL),
    "informal": sql_terms(lx.INFORMAL),
}


def sql_rules(t: str, rules: list[tuple[str, str]]) -> str:
    for a, b in rules:
        flag = "" if a.startswith(("I'", "I ")) else "(?i)"
        t = f"regexp_replace({t}, {q(flag + chr(92) + 'b' + a + chr(92) + 'b')}, {q(b)}, 'g')"
    return sql_closed(t)


def sql_closed(t: str) -> str:
    return f"regexp_replace(regexp_replace({t}, '[{tx.WS}]{{2,}}', ' ', 'g'), '[{tx.WS}]+([,.!?;:])', '\\1', 'g')"


def sql_filler(t: str) -> str:
    for p in lx.FILLER_PREFIXES:
        t = f"regexp_replace({t}, {q('(?i)' + chr(92) + 'b' + p + '[' + tx.WS + ']*')}, '', 'g')"
    return sql_rules(t, lx.FILLER)


def sql_capital(t: str) -> str:
    return f"(upper(left({t}, 1)) || substr({t}, 2))"


def sql_small(t: str) -> str:
    return f"(lower(left({t}, 1)) || substr({t}, 2))"


def sql_tidy(t: str) -> str:
    parts = f"string_split(regexp_replace({sql_closed(t)}, '([.!?])[{tx.WS}]*([a-z])', '\\1' || chr(1) || '\\2', 'g'), chr(1))"
    joined = f"array_to_string(list_transform({parts}, lambda x, i: CASE WHEN i > 1 THEN {sql_capital('x')} ELSE x END), ' ')"
    return f"(SELECT {sql_trim(f'''upper(regexp_extract(j, '^[{tx.WS}]*[a-z]')) || substr(j, length(regexp_extract(j, '^[{tx.WS}]*[a-z]')) + 1)''')} FROM (SELECT {joined} AS j))"


def sql_list(t: str) -> str:
    """An array as text, so that engines agree on its type."""
    return f"array_to_string({t}, '|')"


def _bar(c: str | Column) -> Column:
    return F.array_join(c, "|")


# --- single texts ---
def tokens(spark: SparkSession, d: str) -> DataFrame:
    w = tx.words(F.col("text"))
    return _docs(spark, d).select("doc_id", F.size(w).cast("long").alias("n_tokens"), F.size(F.array_distinct(w)).cast("long").alias("n_distinct"), F.md5(_bar(w)).alias("tokens_md5"))


def sentences(spark: SparkSession, d: str) -> DataFrame:
    s, k = tx.sentences(F.col("text")), tx.sentences_kept(F.col("text"))
    return _seeded(spark, d).select("doc_id", F.size(s).cast("long").alias("n_sentences"), F.md5(_bar(s)).alias("sentences_md5"), F.size(k).cast("long").alias("n_kept"), F.md5(_bar(k)).alias("kept_md5"))


def word_counts(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", tx.word_count(F.col("text")).cast("long").alias("word_count"))


def scalar_profile_by_doc(spark: SparkSession, d: str) -> DataFrame:
    return profile.scalar_profile(_docs(spark, d))


def punctuation_rates(spark: SparkSession, d: str) -> DataFrame:
    t = _seeded(spark, d)
    w, s = F.greatest(F.size(tx.words(F.col("text"))), F.lit(1)), F.greatest(F.size(tx.sentences(F.col("text"))), F.lit(1))
    n = lambda k: tx.count_matches(F.col("text"), profile.COUNTS[k])
    return t.select("doc_id", tx.half_up(n("questions") / s, 3).alias("question_rate"), tx.half_up(n("exclamations") / s, 3).alias("exclamation_rate"), *[tx.half_up(n(k) / w, 4).alias(a) for k, a in (("commas", "comma_density"), ("semicolons", "semicolon_density"), ("dashes", "em_dash_density"))])


def lexicon_rates_seeded(spark: SparkSession, d: str) -> DataFrame:
    t = _seeded(spark, d)
    w, s = F.greatest(F.size(tx.words(F.col("text"))), F.lit(1)), F.greatest(F.size(tx.sentences(F.col("text"))), F.lit(1))
    n = {k: tx.count_matches(F.col("text"), p) for k, p in profile.COUNTS.items()}
    score = tx.clamp(0.5 + (n["formal"] - n["informal"] * 1.4) / s * 0.35)
    return t.select("doc_id", n["contractions"].alias("contractions"), tx.half_up(n["contractions"] / w, 4).alias("contraction_rate"), tx.half_up(n["first_person"] / w, 4).alias("first_person_rate"), tx.half_up(n["passives"] / s, 3).alias("passive_voice_hint"), n["formal"].alias("formal_hits"), n["informal"].alias("informal_hits"), tx.half_up(score, 3).alias("formality_score"))


def transitions_seeded(spark: SparkSession, d: str) -> DataFrame:
    found = F.array_compact(F.array(*[F.when(F.contains(F.lower("text"), F.lit(t)), t) for t in lx.TRANSITIONS]))
    return _seeded(spark, d).select("doc_id", _bar(F.slice(found, 1, 8)).alias("common_transitions"))


# --- authors ---
def _authors(spark: SparkSession, d: str, seeded: bool = True) -> DataFrame:
    t = _seeded(spark, d) if seeded else _docs(spark, d)
    return t.select(F.col("source").alias("author"), F.col("doc_id").alias("ord"), "text")


def _top(spark: SparkSession, d: str, which: tuple[int, int, int]) -> DataFrame:
    n = which[0]
    samples = profile._samples(_authors(spark, d), words=n > 0, sentences=n == 0, counts=False)
    grams = profile.gram_counts(samples, profile._edges(samples), (n,))
    return profile.top_grams(grams, which).select(F.col("author").alias("source"), F.col("rank").cast("long").alias("rank"), "gram", F.col("c").alias("n"))


def top_bigrams_by_source(spark: SparkSession, d: str) -> DataFrame:
    return _top(spark, d, profile.BIGRAMS)


def top_trigrams_by_source(spark: SparkSession, d: str) -> DataFrame:
    return _top(spark, d, profile.TRIGRAMS)


def openers_by_source(spark: SparkSession, d: str) -> DataFrame:
    return _top(spark, d, profile.OPENERS)


def _profiled(spark: SparkSession, d: str) -> DataFrame:
    return profile.profiles(_authors(spark, d)).withColumnRenamed("author", "source")


def signature_phrases(spark: SparkSession, d: str) -> DataFrame:
    return _profiled(spark, d).select("source", _bar("signature_phrases").alias("signature_phrases"))


def tone_notes(spark: SparkSession, d: str) -> DataFrame:
    return _profiled(spark, d).select("source", _bar("tone_notes").alias("tone_notes"))


def summaries(spark: SparkSession, d: str) -> DataFrame:
    return _profiled(spark, d).select("source", "summary")


def profile_by_source(spark: SparkSession, d: str) -> DataFrame:
    p = _profiled(spark, d)
    return p.select(*[_bar(c).alias(c) if t.startswith("array") else F.col(c).cast("long").alias(c) if t == "int" else F.col(c) for c, t in p.dtypes])


def labels_ui(spark: SparkSession, d: str) -> DataFrame:
    p = _profiled(spark, d)
    score, rich = F.col("formality_score"), F.col("vocabulary_richness")
    return p.select(
        "source", tx.half_up(score * 100).cast("long").alias("formality_percent"), F.when(score > lx.SCREEN_FORMAL, "more formal").when(score < lx.SCREEN_CASUAL, "more casual").otherwise("balanced").alias("formality_hint"),
        tx.contraction_label(F.col("contraction_rate"), lx.FREQUENT, lx.RARE).alias("contraction_label"), F.when(rich > lx.VARIED, "Varied").when(rich < lx.REPEATED, "Focused").otherwise("Steady").alias("vocabulary_label"),
        F.concat(tx.half_up(F.col("avg_sentence_length")).cast("long"), F.lit(" w")).alias("sentence_label"), _bar(F.slice("tone_notes", 1, 5)).alias("shown_notes"), _bar(F.slice("signature_phrases", 1, 6)).alias("shown_phrases"), (F.col("sample_count") > 0).alias("has_samples"),
    )


def store_totals(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).groupBy("source").agg(F.sum(tx.word_count(F.col("text")).cast("long")).alias("total_words"), F.count("*").alias("sample_count"))


# --- store ---
_NAMES = ("my.essay.v2.txt", "a.pdf", "notes.md", ".text", "story.PDF", "")
_MIMES = ("text/plain", "application/pdf", "", "text/html")


def ingest_gates(spark: SparkSession, d: str) -> DataFrame:
    pick = lambda values: F.element_at(F.array(*[F.lit(v) for v in values]), (F.pmod("doc_id", F.lit(len(values))) + 1).cast("int"))
    i = F.col("doc_id")
    raw = _docs(spark, d).select(
        "doc_id", "source", pick(("json", "file", "form")).alias("kind"), F.when(i % 5 == 0, F.lit("  ")).when(i % 5 == 1, "Untitled sample").otherwise(F.concat(F.lit(" T"), i, F.lit(" "))).alias("title"),
        F.when(i % 7 == 0, F.left("text", F.lit(30))).when(i % 7 == 1, F.concat(F.lit(" \n"), "text", F.lit(" \t"))).otherwise(F.col("text")).alias("content"), pick(_NAMES).alias("file_name"), pick(_MIMES).alias("mime"), (F.col("n_chars") * 40).alias("bytes"),
    ).withColumn("source", F.when(i % 2 == 0, "upload").otherwise(F.col("source")))
    return store.gated(raw).select("doc_id", "title", "source", "reason", F.length("content").cast("long").alias("n_chars"), F.col("word_count").cast("long").alias("word_count"))


def capacity(spark: SparkSession, d: str) -> DataFrame:
    docs = _docs(spark, d).select(F.col("source").alias("author"), "doc_id")
    there = docs.groupBy("author").agg((F.max("doc_id") % 50).alias("n"))
    return store.within_capacity(docs, there, "doc_id").select("doc_id", "over")


def list_samples(spark: SparkSession, d: str) -> DataFrame:
    docs = _docs(spark, d).select(F.col("doc_id").alias("id"), "source", F.timestamp_seconds(F.lit(1_700_000_000) + F.floor(F.col("doc_id") / 3) * 86_400).alias("created_at"))
    return store.listed(docs).select("id", "source", F.date_format("created_at", "MMM d, yyyy").alias("shown_date"))


def latest_profile(spark: SparkSession, d: str) -> DataFrame:
    versions = _docs(spark, d).select(F.col("source").alias("author"), F.timestamp_seconds(F.lit(1_700_000_000) + F.col("doc_id")).alias("updated_at"), F.concat(F.lit("v"), F.col("doc_id")).alias("name"))
    return store.latest(versions).select(F.col("author").alias("source"), "name")


def truncation(spark: SparkSession, d: str) -> DataFrame:
    """Submissions of up to 30 times a document, most above the longest text that is kept."""
    raw = _submitted(spark, d).withColumn("content", F.repeat(F.concat("content", F.lit(" ")), 30))
    return store.gated(raw).select(F.col("id").alias("doc_id"), F.length("content").cast("long").alias("n_chars"), F.md5("content").alias("content_md5"), F.col("word_count").cast("long").alias("word_count"))


def _submitted(spark: SparkSession, d: str) -> DataFrame:
    docs = _docs(spark, d).select(F.col("source").alias("author"), F.col("doc_id").alias("id"), F.concat(F.lit("T"), "doc_id").alias("title"), F.coalesce("text", F.lit("")).alias("content"))
    return docs.select("*", F.lit("json").alias("kind"), F.lit("paste").alias("source"), F.lit("").alias("file_name"), F.lit("").alias("mime"), F.lit(0).cast("long").alias("bytes"))


def _filled(spark: SparkSession, d: str) -> store.Store:
    """A new store with all documents submitted to it, in the order of their identifiers."""
    s = store.Store(spark, scratch(spark, "store")).create()
    s.add(_submitted(spark, d))
    return s


def store_insert(spark: SparkSession, d: str) -> DataFrame:
    s = _filled(spark, d).samples()
    return s.select("author", "id", "title", F.md5("content").alias("content_md5"), F.col("word_count").cast("long").alias("word_count"), "source")


def store_profiles(spark: SparkSession, d: str) -> DataFrame:
    """The profile versions that the insertion has made."""
    p = store.latest(_filled(spark, d).table("profiles"))
    return p.select("author", "name", "avg_sentence_length", "vocabulary_richness", _bar("signature_phrases").alias("signature_phrases"), _bar("preferred_openers").alias("preferred_openers"), F.col("sample_word_count").cast("long").alias("sample_word_count"), F.col("sample_count").cast("long").alias("sample_count"), "summary")


def store_delete(spark: SparkSession, d: str) -> DataFrame:
    """Two authors' newest samples are deleted, and their profiles made anew."""
    s = _filled(spark, d)
    for r in s.samples().groupBy("author").agg(F.max("id").alias("id")).orderBy("author").limit(2).collect():
        s.delete(r.author, str(r.id))
    left = s.samples().groupBy(F.col("author").alias("_a")).agg(F.max("id").alias("newest"))
    p = store.latest(s.table("profiles")).join(left, F.col("author").eqNullSafe(F.col("_a")))
    return p.select("author", "newest", F.col("sample_word_count").cast("long").alias("sample_word_count"), F.col("sample_count").cast("long").alias("sample_count"))


def empty_profile(spark: SparkSession, d: str) -> DataFrame:
    """Get-or-build for authors without samples."""
    s = store.Store(spark, scratch(spark, "store")).create()
    p = s.profile(_docs(spark, d).select(F.col("source").alias("author")).distinct())
    return p.select("author", "name", "avg_sentence_length", "contraction_rate", "formality_score", _bar("tone_notes").alias("tone_notes"), F.size("signature_phrases").cast("long").alias("n_phrases"), F.col("sample_count").cast("long").alias("sample_count"), "summary")


def rewrite_log(spark: SparkSession, d: str) -> DataFrame:
    """Drafts, every fifth of them blank, rewritten through an empty store: what its log then holds."""
    s = store.Store(spark, scratch(spark, "store")).create()
    blank = F.pmod("doc_id", F.lit(5)) == 0
    s.rewrite(_seeded(spark, d).select(F.col("source").alias("author"), F.col("doc_id").alias("id"), F.when(blank, F.lit(" \n")).otherwise(F.col("text")).alias("text")))
    return s.table("rewrites").select("author", "id", F.md5("original_text").alias("original_md5"), "rewritten_text", "notes")


# --- rewriting ---
def rewrite_blank(spark: SparkSession, d: str) -> DataFrame:
    """Null and blank drafts among others."""
    text = F.when(F.pmod("doc_id", F.lit(3)) == 0, F.lit(None)).when(F.pmod("doc_id", F.lit(3)) == 1, F.lit(" \n\t\u00a0")).otherwise(F.lit("We utilize it."))
    drafts = _docs(spark, d).select("doc_id", F.col("source").alias("author"), text.alias("text"))
    return rewrite.rewrite(drafts, spark.createDataFrame([], store.PROFILE)).select("doc_id", "rewritten", _bar("notes").alias("notes"))


def _rewritten(f: Callable[[Column], Column]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, d: str) -> DataFrame:
        return rewrite.staged(_seeded(spark, d).select("doc_id", "text"), "rewritten", f(F.col("text"))).select("doc_id", "rewritten")

    return run


def rewrite_no_profile(spark: SparkSession, d: str) -> DataFrame:
    nobody = spark.createDataFrame([], store.PROFILE)
    t = rewrite.rewrite(_seeded(spark, d).select("doc_id", F.col("source").alias("author"), "text"), nobody)
    return t.select("doc_id", "rewritten", _bar("notes").alias("notes"))


def _full(spark: SparkSession, d: str) -> DataFrame:
    """Profiles are written first: their size is then known, and drafts are not dealt out by author to join few of them."""
    drafts = _seeded(spark, d).select("doc_id", F.col("source").alias("author"), "text")
    return rewrite.rewrite(drafts, written(_spread(profile.for_rewriting(_authors(spark, d))), "profiles"))


def _spread(p: DataFrame) -> DataFrame:
    """Profiles moved apart by the source's number, so that every branch of the rewrite is taken."""
    k = F.coalesce(F.regexp_extract("author", "([0-9]+)$", 1).try_cast("int"), F.lit(0))
    pick = lambda *v: F.element_at(F.array(*[F.lit(x) for x in v]), (F.pmod(k, F.lit(len(v))) + 1).cast("int"))
    return p.withColumns({"formality_score": pick(0.3, 0.5, 0.7, 0.62), "contraction_rate": pick(0.02, 0.001, 0.01), "avg_sentence_length": pick(3.0, 11.0, 19.0, 28.0, 40.0)})


def rewrite_full(spark: SparkSession, d: str) -> DataFrame:
    return _full(spark, d).select("doc_id", "rewritten")


def rewrite_notes(spark: SparkSession, d: str) -> DataFrame:
    return _full(spark, d).select("doc_id", _bar("notes").alias("notes"))


def split_long(spark: SparkSession, d: str) -> DataFrame:
    return _seeded(spark, d).select("doc_id", F.array_join(rewrite.split_long(tx.sentences_kept(F.col("text")), F.lit(4.0)), " ").alias("rewritten"))


def join_short(spark: SparkSession, d: str) -> DataFrame:
    return _seeded(spark, d).select("doc_id", F.array_join(rewrite.join_short(tx.sentences_kept(F.col("text"))), " ").alias("rewritten"))


def weave_transition(spark: SparkSession, d: str) -> DataFrame:
    return _seeded(spark, d).select("doc_id", F.coalesce(rewrite.woven(F.col("text"), F.lit("however")), "text").alias("rewritten"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "profile_by_source": profile_by_source,
    "tokens": tokens,
    "sentences": sentences,
    "word_counts": word_counts,
    "scalar_profile_by_doc": scalar_profile_by_doc,
    "punctuation_rates": punctuation_rates,
    "lexicon_rates_seeded": lexicon_rates_seeded,
    "transitions_seeded": transitions_seeded,
    "top_bigrams_by_source": top_bigrams_by_source,
    "top_trigrams_by_source": top_trigrams_by_source,
    "openers_by_source": openers_by_source,
    "signature_phrases": signature_phrases,
    "tone_notes": tone_notes,
    "summary": summaries,
    "labels_ui": labels_ui,
    "store_totals": store_totals,
    "ingest_gates": ingest_gates,
    "capacity": capacity,
    "list_samples": list_samples,
    "latest_profile": latest_profile,
    "truncation": truncation,
    "store_insert": store_insert,
    "store_profiles": store_profiles,
    "store_delete": store_delete,
    "empty_profile": empty_profile,
    "rewrite_log": rewrite_log,
    "rewrite_blank": rewrite_blank,
    "rewrite_filler": _rewritten(rewrite.without_filler),
    "rewrite_no_profile": rewrite_no_profile,
    "rewrite_casual": _rewritten(rewrite.casual),
    "rewrite_formal": _rewritten(rewrite.formal),
    "rewrite_contract": _rewritten(rewrite.contracted),
    "rewrite_expand": _rewritten(rewrite.expanded),
    "split_long": split_long,
    "join_short": join_short,
    "weave_transition": weave_transition,
    "tidy": _rewritten(rewrite.tidy),
    "rewrite_full": rewrite_full,
    "rewrite_notes": rewrite_notes,
}

# --- their SQL ---
_ACCEPTED = f"""raw AS (SELECT doc_id, source, lang, {sql_trim("coalesce(text, '')")} AS text, row_number() OVER (ORDER BY doc_id) AS id FROM documents),
kept AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS turn FROM raw WHERE length(text) >= {lx.MIN_CHARS}) WHERE turn <= {lx.MAX_SAMPLES}),
d AS (SELECT doc_id, id, source, lang, left(text, {lx.MAX_CHARS}) AS text FROM kept)"""
_W, _S = sql_words("text"), sql_sentences("text")
_COMBINED = f"c AS (SELECT source, coalesce(string_agg(text, chr(10) || chr(10) ORDER BY doc_id DESC) FILTER (WHERE {sql_trim('text')} <> ''), '') AS text, count(*) AS n FROM d GROUP BY source)"
_TOKENS = f"w AS (SELECT source, text, n, {_W} AS w, {_S} AS s FROM c)"


def _sql_grams(n: int) -> str:
    ahead = "".join(f" || ' ' || lead(a, {i}) OVER (PARTITION BY source ORDER BY pos)" for i in range(1, n))
    each = "SELECT source, unnest(w) AS a, unnest(range(1, len(w) + 1)) AS pos FROM w"
    return f"g AS (SELECT source, gram, pos FROM (SELECT source, pos, a{ahead} AS gram FROM ({each})) WHERE gram IS NOT NULL)"


_SQL_OPENERS = f"g AS (SELECT source, gram, pos FROM (SELECT source, unnest(list_transform(s, lambda x: array_to_string(({sql_words('x')})[1:3], ' '))) AS gram, unnest(range(1, len(s) + 1)) AS pos FROM w) WHERE length(gram) > 2)"


def _sql_top(grams: str, k: int, least: int) -> str:
    ranked = f"r AS (SELECT source, gram, count(*) AS n, row_number() OVER (PARTITION BY source ORDER BY count(*) DESC, min(pos)) AS rank FROM g GROUP BY source, gram HAVING count(*) >= {least})"
    return f"WITH {D}, {_COMBINED}, {_TOKENS}, {grams}, {ranked} SELECT source, rank, gram, n FROM r WHERE rank <= {k}"


def _sql_profile(docs: str = D) -> str:
    n = {k: sql_count("text", p) for k, p in SQL_COUNTS.items()}
    has = ", ".join(f"CASE WHEN contains(lower(text), {q(t)}) THEN {q(t)} END" for t in lx.TRANSITIONS)
    t = lx.TONE
    return f"""{docs}, {_COMBINED}, {_TOKENS},
b AS (SELECT source, gram, n, row_number() OVER (PARTITION BY source ORDER BY n DESC, pos) AS rank FROM (SELECT source, gram, count(*) AS n, min(pos) AS pos FROM ({_sql_grams(2)[6:-1]}) GROUP BY source, gram HAVING count(*) >= 3)),
t3 AS (SELECT source, gram, n, row_number() OVER (PARTITION BY source ORDER BY n DESC, pos) AS rank FROM (SELECT source, gram, count(*) AS n, min(pos) AS pos FROM ({_sql_grams(3)[6:-1]}) GROUP BY source, gram HAVING count(*) >= 2)),
o AS (SELECT source, gram, n, row_number() OVER (PARTITION BY source ORDER BY n DESC, pos) AS rank FROM (SELECT source, gram, count(*) AS n, min(pos) AS pos FROM ({_SQL_OPENERS[6:-1]}) GROUP BY source, gram)),
phrases AS (SELECT source, list(gram ORDER BY part, rank)[1:8] AS p FROM (SELECT 1 AS part, * FROM t3 WHERE rank <= 4 UNION ALL SELECT 2, * FROM b WHERE rank <= 6) GROUP BY source),
opened AS (SELECT source, list(gram ORDER BY rank) AS p FROM o WHERE rank <= 5 GROUP BY source),
m AS (SELECT source, text, n, w, s, greatest(len(w), 1)::DOUBLE AS nw, greatest(len(s), 1)::DOUBLE AS ns, {', '.join(f'{c} AS {k}' for k, c in n.items())} FROM w),
v AS (SELECT *, nw / ns AS sentence, len(list_distinct(w)) / nw AS rich, contractions / nw AS contraction, questions / ns AS question, dashes / nw AS dash, semicolons / nw AS semis, first_person / nw AS firsts, least(1.0, greatest(0.0, 0.5 + (formal - informal * 1.4::DOUBLE) / ns * 0.35::DOUBLE)) AS score FROM m),
z AS (SELECT source, {sql_round('sentence', 2)} AS avg_sentence_length, {sql_round("length(replace(array_to_string(w, ''), '''', '')) / nw", 2)} AS avg_word_length, {sql_round('rich', 3)} AS vocabulary_richness, {sql_round('contraction', 4)} AS contraction_rate,
 {sql_round('question', 3)} AS question_rate, {sql_round('exclamations / ns', 3)} AS exclamation_rate, {sql_round('commas / nw', 4)} AS comma_density, {sql_round('semis', 4)} AS semicolon_density, {sql_round('dash', 4)} AS em_dash_density, {sql_round('firsts', 4)} AS first_person_rate,
 {sql_round('passives / ns', 3)} AS passive_voice_hint, {sql_round('score', 3)} AS formality_score, list_filter([{has}], lambda x: x IS NOT NULL)[1:8] AS common_transitions, coalesce(phrases.p, []) AS signature_phrases, coalesce(opened.p, []) AS preferred_openers,
 list_filter([CASE WHEN sentence < 12 THEN {q(t['short'])} WHEN sentence > 22 THEN {q(t['long'])} ELSE {q(t['moderate'])} END, CASE WHEN contraction >= {lx.FREQUENT} THEN {q(t['frequent'])} WHEN contraction < {lx.RARE} THEN {q(t['rare'])} ELSE {q(t['some'])} END,
  CASE WHEN score > {lx.TONE_FORMAL} THEN {q(t['formal'])} WHEN score < {lx.TONE_CASUAL} THEN {q(t['casual'])} ELSE {q(t['balanced'])} END, CASE WHEN firsts > 0.04 THEN {q(t['first'])} END, CASE WHEN question > 0.12 THEN {q(t['question'])} END, CASE WHEN dash > 0.004 THEN {q(t['dash'])} END,
  CASE WHEN semis > 0.002 THEN {q(t['semicolon'])} END, CASE WHEN rich > {lx.VARIED} THEN {q(t['varied'])} WHEN rich < {lx.REPEATED} THEN {q(t['repeated'])} END], lambda x: x IS NOT NULL) AS tone_notes, len(w)::BIGINT AS sample_word_count, n AS sample_count
 FROM v LEFT JOIN phrases USING (source) LEFT JOIN opened USING (source)),
y AS (SELECT *, 'Based on ' || sample_count || CASE WHEN sample_count = 1 THEN ' sample (' ELSE ' samples (' END || sample_word_count || ' words). Typical sentence ~' || floor(avg_sentence_length + 0.5)::BIGINT || ' words. ' || array_to_string(list_transform(tone_notes[1:4], lambda x: {sql_capital('x')} || '.'), ' ')
 || CASE WHEN len(signature_phrases) > 0 THEN ' Recurring phrases: ' || array_to_string(list_transform(signature_phrases[1:4], lambda x: '"' || x || '"'), ', ') || '.' ELSE '' END AS summary FROM z)"""


_P = "WITH " + _sql_profile()
_SCALARS = "avg_sentence_length, avg_word_length, vocabulary_richness, contraction_rate, question_rate, exclamation_rate, comma_density, semicolon_density, em_dash_density, first_person_rate, passive_voice_hint, formality_score"
_LISTS = ("common_transitions", "signature_phrases", "preferred_openers", "tone_notes")


def _sql_cut(s: str, target: str) -> str:
    pieces = f"string_split(regexp_replace({s}, '(?i)[{tx.WS}]+(?:, and|and|, but|but|;)[{tx.WS}]+', chr(1), 'g'), chr(1))"
    ended = f"list_transform(list_transform({pieces}, lambda p: {sql_trim('p')}), lambda p: {sql_capital('''CASE WHEN regexp_matches(p, '[.!?]$') THEN p ELSE p || '.' END''')})"
    return f"CASE WHEN len({pieces}) > 1 AND len({sql_words(s)}) > {target} + 4 THEN {ended} ELSE [{s}] END"


def _sql_split(kept: str, target: str) -> str:
    return f"array_to_string(flatten(list_transform({kept}, lambda s: {_sql_cut('s', target)})), ' ')"


#: Gaps and islands: in each run of places that may join, the first, third and so on do.
_SQL_JOIN = f"""k AS (SELECT doc_id, text, {sql_kept('text')} AS ks FROM {{src}}),
p AS (SELECT doc_id, unnest(ks) AS cur, unnest(range(1, len(ks) + 1)) AS i FROM k),
x AS (SELECT doc_id, i, cur, lead(cur) OVER (PARTITION BY doc_id ORDER BY i) AS nxt, len({sql_words('cur')}) AS n FROM p),
f AS (SELECT *, nxt IS NOT NULL AND n < 10 AND lead(n) OVER (PARTITION BY doc_id ORDER BY i) < 14 AND NOT cur LIKE '%?' AS fits FROM x),
r AS (SELECT *, i - sum(CASE WHEN fits THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM f),
u AS (SELECT *, fits AND (row_number() OVER (PARTITION BY doc_id, run, fits ORDER BY i)) % 2 = 1 AS joins FROM r),
j AS (SELECT doc_id, i, CASE WHEN joins THEN regexp_replace(cur, '[.!]$', '') || ', and ' || {sql_small('nxt')} ELSE cur END AS out, coalesce(lag(joins) OVER (PARTITION BY doc_id ORDER BY i), false) AS gone FROM u),
joined AS (SELECT doc_id, string_agg(out, ' ' ORDER BY i) AS joined FROM j WHERE NOT gone GROUP BY doc_id)"""


def _sql_woven(t: str, kept: str, transition: str) -> str:
    new = f"array_to_string(list_transform({kept}, lambda x, i: CASE WHEN i = 2 THEN {sql_capital(transition)} || ', ' || {sql_small('x')} ELSE x END), ' ')"
    return f"CASE WHEN len({kept}) >= 3 AND {transition} <> '' AND NOT contains(lower({t}), {transition}) THEN {new} END"


def _sql_full() -> str:
    k = "coalesce(try_cast(nullif(regexp_extract(source, '([0-9]+)$', 1), '') AS INTEGER), 0)"
    return f"""{_P}, q AS (SELECT source, ([0.3, 0.5, 0.7, 0.62])[{k} % 4 + 1]::DOUBLE AS score, ([0.02, 0.001, 0.01])[{k} % 3 + 1]::DOUBLE AS rate, ([3.0, 11.0, 19.0, 28.0, 40.0])[{k} % 5 + 1]::DOUBLE AS target, common_transitions[1] AS first, tone_notes FROM y),
a1 AS (SELECT doc_id, q.*, {sql_trim('text')} AS t0 FROM d JOIN q USING (source)), a2 AS (SELECT *, {sql_filler('t0')} AS t1 FROM a1),
a3 AS (SELECT *, CASE WHEN score < 0.45 THEN {sql_rules('t1', lx.FORMAL_TO_CASUAL)} WHEN score > 0.62 THEN {sql_rules('t1', lx.CASUAL_TO_FORMAL)} ELSE t1 END AS t2 FROM a2),
a4 AS (SELECT *, CASE WHEN rate >= 0.015 THEN {sql_rules('t2', lx.CONTRACTED)} WHEN rate < 0.008 THEN {sql_rules('t2', lx.EXPANSIONS)} ELSE t2 END AS text FROM a3),
{_SQL_JOIN.replace('{src}', 'a4')},
a5 AS (SELECT a4.*, joined, {sql_kept('a4.text')} AS kept, len({sql_words('a4.text')}) / greatest(len({sql_kept('a4.text')}), 1)::DOUBLE AS mean FROM a4 LEFT JOIN joined USING (doc_id)),
a6 AS (SELECT *, CASE WHEN mean > target + 6 THEN {_sql_split('kept', 'target')} WHEN mean < target - 6 AND len(kept) > 1 THEN joined ELSE text END AS t3 FROM a5),
a7 AS (SELECT *, {sql_kept('t3')} AS kept3 FROM a6), a8 AS (SELECT *, CASE WHEN score >= 0.5 AND first IS NOT NULL THEN {_sql_woven('t3', 'kept3', 'first')} END AS t4 FROM a7)"""


_FULL = _sql_full()
_LOOK = lambda t: f"WITH {D} SELECT doc_id, {t} AS rewritten FROM d"
N = lx.NOTE
ORACLE_SQL: dict[str, str] = {
    "profile_by_source": f"{_P} SELECT source, {_SCALARS}, {', '.join(f'{sql_list(c)} AS {c}' for c in _LISTS)}, sample_word_count, sample_count, summary FROM y",
    "tokens": f"WITH w AS (SELECT doc_id, {_W} AS w FROM documents) SELECT doc_id, len(w)::BIGINT AS n_tokens, len(list_distinct(w))::BIGINT AS n_distinct, md5({sql_list('w')}) AS tokens_md5 FROM w",
    "sentences": f"WITH {D}, w AS (SELECT doc_id, {_S} AS s, {sql_kept('text')} AS k FROM d) SELECT doc_id, len(s)::BIGINT AS n_sentences, md5({sql_list('s')}) AS sentences_md5, len(k)::BIGINT AS n_kept, md5({sql_list('k')}) AS kept_md5 FROM w",
    "word_counts": f"SELECT doc_id, len(list_filter(string_split_regex({sql_trim('text')}, '[{tx.WS}]+'), lambda x: x <> ''))::BIGINT AS word_count FROM documents",
    "scalar_profile_by_doc": f"WITH w AS (SELECT doc_id, {_W} AS w, greatest(len({_S}), 1) AS s FROM documents), v AS (SELECT *, greatest(len(w), 1) AS n FROM w) SELECT doc_id, {sql_round('n / s', 2)} AS avg_sentence_length, {sql_round("length(replace(array_to_string(w, ''), '''', '')) / n", 2)} AS avg_word_length, {sql_round('len(list_distinct(w)) / n', 3)} AS vocabulary_richness, len(w)::BIGINT AS sample_word_count FROM v",
    "punctuation_rates": f"WITH {D}, v AS (SELECT doc_id, text, greatest(len({_W}), 1) AS w, greatest(len({_S}), 1) AS s FROM d) SELECT doc_id, {sql_round(sql_count('text', SQL_COUNTS['questions']) + ' / s', 3)} AS question_rate, {sql_round(sql_count('text', '!') + ' / s', 3)} AS exclamation_rate, {sql_round(sql_count('text', ',') + ' / w', 4)} AS comma_density, {sql_round(sql_count('text', ';') + ' / w', 4)} AS semicolon_density, {sql_round(sql_count('text', SQL_COUNTS['dashes']) + ' / w', 4)} AS em_dash_density FROM v",
    "lexicon_rates_seeded": f"WITH {D}, v AS (SELECT doc_id, greatest(len({_W}), 1) AS w, greatest(len({_S}), 1) AS s, {', '.join(f'{sql_count("text", p)} AS {k}' for k, p in SQL_COUNTS.items())} FROM d) SELECT doc_id, contractions, {sql_round('contractions / w', 4)} AS contraction_rate, {sql_round('first_person / w', 4)} AS first_person_rate, {sql_round('passives / s', 3)} AS passive_voice_hint, formal AS formal_hits, informal AS informal_hits, {sql_round('least(1.0, greatest(0.0, 0.5 + (formal - informal * 1.4::DOUBLE) / s * 0.35::DOUBLE))', 3)} AS formality_score FROM v",
    "transitions_seeded": f"WITH {D} SELECT doc_id, coalesce(array_to_string(list_filter([{', '.join(f'CASE WHEN contains(lower(text), {q(t)}) THEN {q(t)} END' for t in lx.TRANSITIONS)}], lambda x: x IS NOT NULL)[1:8], '|'), '') AS common_transitions FROM d",
    "top_bigrams_by_source": _sql_top(_sql_grams(2), 6, 3),
    "top_trigrams_by_source": _sql_top(_sql_grams(3), 4, 2),
    "openers_by_source": _sql_top(_SQL_OPENERS, 5, 1),
    "signature_phrases": f"{_P} SELECT source, {sql_list('signature_phrases')} AS signature_phrases FROM y",
    "tone_notes": f"{_P} SELECT source, {sql_list('tone_notes')} AS tone_notes FROM y",
    "summary": f"{_P} SELECT source, summary FROM y",
    "labels_ui": f"{_P} SELECT source, floor(formality_score * 100 + 0.5)::BIGINT AS formality_percent, CASE WHEN formality_score > 0.6 THEN 'more formal' WHEN formality_score < 0.4 THEN 'more casual' ELSE 'balanced' END AS formality_hint, CASE WHEN contraction_rate >= 0.015 THEN 'Frequent' WHEN contraction_rate < 0.008 THEN 'Rare' ELSE 'Some' END AS contraction_label, CASE WHEN vocabulary_richness > 0.55 THEN 'Varied' WHEN vocabulary_richness < 0.35 THEN 'Focused' ELSE 'Steady' END AS vocabulary_label, floor(avg_sentence_length + 0.5)::BIGINT || ' w' AS sentence_label, {sql_list('tone_notes[1:5]')} AS shown_notes, {sql_list('signature_phrases[1:6]')} AS shown_phrases, sample_count > 0 AS has_samples FROM y",
    "store_totals": f"SELECT source, sum(len(list_filter(string_split_regex({sql_trim('text')}, '[{tx.WS}]+'), lambda x: x <> '')))::BIGINT AS total_words, count(*) AS sample_count FROM documents GROUP BY source",
    "ingest_gates": f"""WITH r AS (SELECT doc_id, (['json', 'file', 'form'])[doc_id % 3 + 1] AS kind, CASE WHEN doc_id % 5 = 0 THEN '' WHEN doc_id % 5 = 1 THEN 'Untitled sample' ELSE 'T' || doc_id END AS asked,
 {sql_trim('''CASE WHEN doc_id % 7 = 0 THEN left(text, 30) ELSE text END''')} AS content, ([{', '.join(q(n or 'upload.txt') for n in _NAMES)}])[doc_id % {len(_NAMES)} + 1] AS name, ([{', '.join(map(q, _MIMES))}])[doc_id % {len(_MIMES)} + 1] AS mime, n_chars * 40 AS bytes FROM documents)
SELECT doc_id, CASE WHEN kind = 'file' AND asked IN ('', 'Untitled sample') THEN coalesce(nullif(left(regexp_replace(name, '\\.[^.]+$', ''), 200), ''), 'Uploaded sample') WHEN asked = '' THEN 'Untitled sample' ELSE asked END AS title,
 CASE WHEN kind = 'file' OR kind = 'json' AND doc_id % 2 = 0 THEN 'upload' ELSE 'paste' END AS source,
 CASE WHEN kind = 'file' AND NOT regexp_matches(lower(name), '\\.(txt|md|markdown|text)$') AND mime <> '' AND mime NOT LIKE 'text/%' THEN 'file_type' WHEN kind = 'file' AND bytes > 100000 THEN 'file_size' WHEN length(content) < 40 THEN 'too_short' END AS reason,
 length(left(content, 50000))::BIGINT AS n_chars, len(list_filter(string_split_regex({sql_trim('left(content, 50000)')}, '[{tx.WS}]+'), lambda x: x <> ''))::BIGINT AS word_count FROM r""",
    "capacity": "SELECT doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) + max(doc_id) OVER (PARTITION BY source) % 50 > 40 AS over FROM documents",
    "list_samples": "SELECT doc_id AS id, source, strftime(TIMESTAMP '1970-01-01' + to_seconds(1700000000 + (doc_id // 3) * 86400), '%b %-d, %Y') AS shown_date FROM documents ORDER BY 1 DESC",
    "latest_profile": "SELECT source, 'v' || max(doc_id) AS name FROM documents GROUP BY source",
    "truncation": f"WITH r AS (SELECT doc_id, left({sql_trim("repeat(coalesce(text, '') || ' ', 30)")}, {lx.MAX_CHARS}) AS t FROM documents) SELECT doc_id, length(t)::BIGINT AS n_chars, md5(t) AS content_md5, {sql_word_count('t')} AS word_count FROM r",
    "store_insert": f"WITH {_ACCEPTED} SELECT source AS author, id, 'T' || doc_id AS title, md5(text) AS content_md5, {sql_word_count('text')} AS word_count, 'paste' AS source FROM d",
    "store_profiles": f"WITH {_sql_profile(_ACCEPTED)} SELECT source AS author, 'My writing style' AS name, avg_sentence_length, vocabulary_richness, {sql_list('signature_phrases')} AS signature_phrases, {sql_list('preferred_openers')} AS preferred_openers, sample_word_count, sample_count, summary FROM y",
    "store_delete": f"WITH {_ACCEPTED}, gone AS (SELECT max(id) AS id FROM d GROUP BY source ORDER BY source LIMIT 2) SELECT source AS author, max(id) AS newest, sum(len({sql_words('text')}))::BIGINT AS sample_word_count, count(*) AS sample_count FROM d WHERE id NOT IN (SELECT id FROM gone) GROUP BY source",
    "empty_profile": f"SELECT DISTINCT source AS author, 'My writing style' AS name, 16.0::DOUBLE AS avg_sentence_length, 0.02::DOUBLE AS contraction_rate, 0.5::DOUBLE AS formality_score, 'Upload writing samples so the engine can learn your voice' AS tone_notes, 0::BIGINT AS n_phrases, 0::BIGINT AS sample_count, 'No samples uploaded yet.' AS summary FROM documents",
    "rewrite_blank": f"SELECT doc_id, CASE WHEN doc_id % 3 = 2 THEN 'We use it.' ELSE '' END AS rewritten, CASE WHEN doc_id % 3 = 2 THEN {q(lx.NOTE['general'])} ELSE 'Add some text to rewrite.' END AS notes FROM documents",
    "rewrite_filler": _LOOK(sql_filler("text")),
    "rewrite_no_profile": f"WITH {D}, a AS (SELECT doc_id, {sql_trim('text')} AS t0 FROM d), b AS (SELECT *, {sql_filler('t0')} AS t1 FROM a), e AS (SELECT *, {sql_rules('t1', lx.FORMAL_TO_CASUAL[: lx.GENERAL_RULES])} AS t2 FROM b) SELECT doc_id, CASE WHEN t0 = '' THEN '' ELSE {sql_tidy('t2')} END AS rewritten, CASE WHEN t0 = '' THEN {q(N['empty'])} ELSE CASE WHEN t1 <> t0 THEN {q(N['filler'] + '|')} ELSE '' END || {q(N['general'])} END AS notes FROM e",
    "rewrite_casual": _LOOK(sql_rules("text", lx.FORMAL_TO_CASUAL)),
    "rewrite_formal": _LOOK(sql_rules("text", lx.CASUAL_TO_FORMAL)),
    "rewrite_contract": _LOOK(sql_rules("text", lx.CONTRACTED)),
    "rewrite_expand": _LOOK(sql_rules("text", lx.EXPANSIONS)),
    "split_long": _LOOK(_sql_split(sql_kept("text"), "4.0")),
    "join_short": f"WITH {D}, {_SQL_JOIN.replace('{src}', 'd')} SELECT doc_id, coalesce(joined, '') AS rewritten FROM d LEFT JOIN joined USING (doc_id)",
    "weave_transition": f"WITH {D}, v AS (SELECT *, {sql_kept('text')} AS ks FROM d) SELECT doc_id, coalesce({_sql_woven('text', 'ks', q('however'))}, text) AS rewritten FROM v",
    "tidy": _LOOK(sql_tidy("text")),
    "rewrite_full": f"{_FULL} SELECT doc_id, CASE WHEN t0 = '' THEN '' ELSE {sql_tidy('coalesce(t4, t3)')} END AS rewritten FROM a8",
    "rewrite_notes": f"{_FULL} SELECT doc_id, CASE WHEN t0 = '' THEN {q(N['empty'])} ELSE array_to_string(list_filter([CASE WHEN t1 <> t0 THEN {q(N['filler'])} END, CASE WHEN score < 0.45 THEN {q(N['casual'])} WHEN score > 0.62 THEN {q(N['formal'])} ELSE {q(N['balanced'])} END, CASE WHEN rate >= 0.015 THEN {q(N['contract'])} WHEN rate < 0.008 THEN {q(N['expand'])} END, CASE WHEN t3 <> text THEN 'Tuned sentence rhythm toward ~' || floor(target + 0.5)::BIGINT || ' words' END, CASE WHEN t4 IS NOT NULL THEN 'Wove in a transition you often use (“' || first || '”)' END, 'Style cue: ' || tone_notes[1], 'Style cue: ' || tone_notes[2]], lambda x: x IS NOT NULL), '|') END AS notes FROM a8",
}
ORACLE_SQL["rewrite_log"] = f"WITH r AS ({ORACLE_SQL['rewrite_no_profile']}), {D} SELECT d.source AS author, doc_id AS id, md5(d.text) AS original_md5, rewritten AS rewritten_text, replace(notes, '|', chr(10)) AS notes FROM r JOIN d USING (doc_id) WHERE doc_id % 5 <> 0"
