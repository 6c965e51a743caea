"""Style profiles of authors, as if each author's samples, newest first, were one text joined by blank lines.

No author's text is ever put together: metrics are sums over samples, n-grams and openers are counted as rows, and what
crosses the border of two samples (a sentence without an end mark, an n-gram, a passive) comes from narrow rows that meet
their neighbours by an equi-join on running numbers. So an author with a third of all samples is as many tasks.

Every sample is tokenised once; what the later steps need of it is a table in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lexicon as lx
from ..functions import text as tx
from ..sources.shared import running, written

PASSIVE = rf"(?i)(?<![A-Za-z0-9_])(?:{'|'.join(lx.BE_FORMS)})[{tx.WS}]+[A-Za-z0-9_]+(?:ed|en)(?![A-Za-z0-9_])"
COUNTS = {
    "contractions": tx.any_of(lx.CONTRACTIONS),
    "questions": r"\?",
    "exclamations": "!",
    "commas": ",",
    "semicolons": ";",
    "dashes": "—|--",
    "first_person": tx.any_of(lx.FIRST_PERSON),
    "passives": PASSIVE,
    "formal": tx.any_of(lx.FORMAL),
    "informal": tx.any_of(lx.INFORMAL),
}
#: n-grams: (n, how many, at least so often)
TRIGRAMS, BIGRAMS, OPENERS = (3, 4, 2), (2, 6, 3), (0, 5, 1)
PHRASES, SHOWN_TRANSITIONS = 8, 8


#: The start of a lower-case sentence, up to its third word.
_THREE_WORDS = r"^(?:[^a-z0-9'-]*+[a-z0-9'-]++){0,3}"
#: Passives that cross samples. Of the forms of be only this one can end a passive and begin the next, so a run of them
#: carries on what was pending before it; a sample of nothing else hands it to the next sample.
_RUN = "been"
_PLACES = 1 << 31
#: A sample's end with an end mark.
ENDED = rf"[.!?][{tx.WS}]*\z"


def openers(sentence: Column) -> Column:
    """The first three words; only the sentence's start is tokenised."""
    return F.array_join(F.slice(tx.words(F.regexp_extract(F.lower(sentence), _THREE_WORDS, 0)), 1, 3), " ")


def counted(text: Column) -> list[Column]:
    return [tx.count_matches(text, p).alias(n) for n, p in COUNTS.items()]


def _passives(c: Column) -> Column:
    return tx.count_matches(c, PASSIVE)


def _pending(c: Column) -> Column:
    """1 where a form of be at the end waits for its participle, else 0."""
    return _passives(F.concat(c, F.lit(" taken"))) - _passives(c)


def _samples(df: DataFrame, words: bool = True, sentences: bool = True, counts: bool = True) -> DataFrame:
    """One row per sample that is not blank, with what is asked for: tokens (w), sentence openers (so), the counts that
    make the metrics. Written, as several steps read it."""
    text = F.col("text")
    t = df.filter(tx.trim(text) != "").select("author", "ord", "text")
    t = t.withColumn("w", tx.words(text)) if words else t
    t = t.withColumn("s", tx.sentences(text)) if sentences else t
    t = tx.settled(t)
    ends = text.rlike(ENDED)
    oldest = F.lit("9223372036854775808").cast("decimal(20,0)")
    start = F.coalesce(-F.col("ord").cast("decimal(20,0)"), oldest) * F.lit(_PLACES).cast("decimal(10,0)")
    picked = ["author", "ord", start.alias("start")]
    if words:
        picked += ["w", F.size("w").alias("n_w")]
    if sentences:
        three = lambda i: F.filter(F.split(openers(F.element_at("s", i)), " "), lambda x: x != "")
        picked += [F.size("s").alias("n_s"), F.transform("s", openers).alias("so"), three(1).alias("s_first"), three(-1).alias("s_last"), (~ends).alias("open")]
    if counts:
        run = rf"(?i)^[{tx.WS}]*(?:{_RUN}[{tx.WS}]+)*(?:{_RUN}\z|[^{tx.WS}]*)"
        back = rf"(?i)^[{tx.WS}]*(?:{_RUN[::-1]}[{tx.WS}]+)*[^{tx.WS}]*"
        head, tail = F.regexp_extract("text", run, 0), F.reverse(F.regexp_extract(F.reverse("text"), back, 0))
        pure = text.rlike(rf"(?i)^[{tx.WS}]*{_RUN}(?:[{tx.WS}]+{_RUN})*[{tx.WS}]*\z")
        picked += [
            tx.letters(F.col("w")).alias("chars"), *counted(text), *[F.contains(F.lower("text"), F.lit(x)).alias(f"t{i}") for i, x in enumerate(lx.TRANSITIONS)],
            (_passives(F.concat(F.lit("is "), head)) - _passives(head)).alias("taken_over"), _pending(tail).alias("pending"), pure.alias("pure"),
        ]
    return written(t.select(*picked), "samples")


def _edges(samples: DataFrame) -> DataFrame:
    """Narrow rows of what may cross a border, numbered in the authors' order: those with tokens; those that are not a
    sentence without tokens and end (which changes no opener); those that settle what is pending, and those that turn it."""
    picked: list[Column] = []
    sums: dict[str, str] = {}
    if "w" in samples.columns:
        picked += [F.slice("w", 1, 2).alias("first"), F.reverse(F.slice(F.reverse("w"), 1, 2)).alias("last"), F.col("n_w"), (F.col("n_w") > 0).cast("long").alias("tok")]
        sums["i_tok"] = "tok"
    if "so" in samples.columns:
        picked += [F.col(c) for c in ("open", "n_s", "s_first", "s_last")] + [(~((F.col("n_s") == 1) & F.col("open") & (F.size("s_first") == 0))).cast("long").alias("opn")]
        sums["i_opn"] = "opn"
    if "pure" in samples.columns:
        picked += [F.col("taken_over"), F.col("pending"), (~F.col("pure")).cast("long").alias("set"), (F.col("pure") & (F.col("pending") == 1)).cast("long").alias("turn")]
        sums |= {"i_set": "set", "i_turn": "turn"}
    e = samples.select("author", "ord", "start", *picked)
    return written(running(e, [F.asc_nulls_first("author"), F.desc_nulls_last("ord")], sums), "edges")


def _joined(e: DataFrame, index: str, steps: dict[int, list[str]]) -> DataFrame:
    """e's rows of that index, each with columns of the rows some places further on for the same author, tagged by the step."""
    flag = {"i_tok": "tok", "i_opn": "opn"}[index]
    own = out = e.filter(F.col(flag) == 1)
    for step, cols in steps.items():
        tag = f"_{step}".replace("-", "m")
        near = own.select(F.col("author").alias("_a"), (F.col(index) - step).alias("_i"), *[F.col(c).alias(c + tag) for c in cols])
        out = out.join(near, (F.col(index) == F.col("_i")) & F.col("author").eqNullSafe(F.col("_a")), "left").drop("_a", "_i")
    return out


def _border_passives(e: DataFrame) -> DataFrame:
    """What passives over borders add to an author's samples' own: where a form of be is pending at a sample's start, the
    matches of its leading run shift by one. It is pending as the last sample that is no pure run left it, turned by each
    pure run of an odd length since."""
    settled = e.filter("set = 1").select(F.col("author").alias("_a"), F.col("i_set").alias("_i"), F.col("pending").alias("_pending"), F.col("i_turn").alias("_turned"))
    at = e.join(settled, (F.col("i_set") - 1 == F.col("_i")) & F.col("author").eqNullSafe(F.col("_a")), "left")
    # the first samples of an author have no such sample before them: runs are counted from the author's first
    first = e.groupBy("author").agg(F.min("i_turn").alias("_none")).withColumnRenamed("author", "_b")
    at = at.join(first, F.col("author").eqNullSafe(F.col("_b")), "left")
    is_pending = (F.coalesce("_pending", F.lit(0)) + F.col("i_turn") - F.coalesce("_turned", "_none")) % 2 == 1
    return at.filter(is_pending).groupBy("author").agg(F.sum("taken_over").alias("border_passives"))


def _gram_rows(samples: DataFrame, e: DataFrame, kinds: tuple[int, ...]) -> DataFrame:
    """(author, n, gram, at) for the wanted kinds: n-grams and, as n = 0, sentence openers. at orders by sample, newest
    first, then by place; one number, so that sums and minima fit into a hash table's row."""
    none = F.array().cast("array<string>")

    def rows(df: DataFrame, n: int, grams: Column) -> DataFrame:
        at = F.col("start") + F.col("pos").cast("decimal(10,0)")
        return df.select("author", "start", F.posexplode(grams).alias("pos", "gram")).select("author", F.lit(n).alias("n"), "gram", at.alias("at"))

    def placed(df: DataFrame, n: int, grams: Column) -> DataFrame:
        """grams: array<struct<gram, pos>>"""
        at = F.col("start") + F.col("g.pos").cast("decimal(10,0)")
        return df.select("author", "start", F.explode(grams).alias("g")).select("author", F.lit(n).alias("n"), "g.gram", at.alias("at"))

    found = []
    for n in (n for n in kinds if n):
        found.append(rows(samples, n, tx.ngrams(F.col("w"), n)))
        if n > 1:  # n-grams that start in the last two tokens of a sample and end in the next ones
            t = _joined(e, "i_tok", {i: ["first"] for i in range(1, n)})
            after = F.coalesce("first_1", none)
            if n > 2:
                after = F.concat(after, F.when(F.size(after) == 1, F.coalesce("first_2", none)).otherwise(none))
            stream, k = F.concat("last", after), F.size("last")
            starts = F.filter(F.sequence(F.greatest(k - n + 2, F.lit(1)), F.greatest(k, F.lit(1))), lambda i: i + n - 1 <= F.size(stream))  # noqa: B023
            found.append(placed(t, n, F.transform(starts, lambda i: F.struct(F.array_join(F.slice(stream, i, n), " ").alias("gram"), (F.col("n_w") - k + i - 1).cast("long").alias("pos")))))  # noqa: B023
    if 0 in kinds:
        inner = F.when(F.size("so") > 2, F.slice("so", 2, F.greatest(F.size("so") - 2, F.lit(0)))).otherwise(none)
        found.append(placed(samples, 0, F.transform(inner, lambda g, i: F.struct(g.alias("gram"), (i + 1).cast("long").alias("pos")))))
        # openers of first and last sentences
        o = _joined(e, "i_opn", {-1: ["open"], 1: ["s_first", "open", "n_s"], 2: ["s_first", "open", "n_s"], 3: ["s_first"]})
        goes_on = lambda i: F.coalesce(F.col(f"open_{i}") & (F.col(f"n_s_{i}") == 1), F.lit(False))
        rest = F.concat(F.coalesce("s_first_1", none), F.when(goes_on(1), F.concat(F.coalesce("s_first_2", none), F.when(goes_on(2), F.coalesce("s_first_3", none)).otherwise(none))).otherwise(none))
        full = F.array_join(F.slice(F.concat("s_last", F.when(F.col("open"), rest).otherwise(none)), 1, 3), " ")
        begins = ~F.coalesce("open_m1", F.lit(False))
        lone = F.col("n_s") == 1
        ends = F.array(
            F.when(begins, F.struct(F.when(lone, full).otherwise(F.array_join("s_first", " ")).alias("gram"), F.lit(0).cast("long").alias("pos"))),
            F.when(~lone, F.struct(full.alias("gram"), (F.col("n_s") - 1).cast("long").alias("pos"))),
        )
        found.append(placed(o, 0, F.array_compact(ends)))
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out.filter((F.col("n") > 0) | (F.length("gram") > 2))


def gram_counts(samples: DataFrame, e: DataFrame, kinds: tuple[int, ...]) -> DataFrame:
    """(author, n, gram, c, at): how often, and where first (newest sample, then place)."""
    return _gram_rows(samples, e, kinds).groupBy("author", "n", "gram").agg(F.count("*").alias("c"), F.min("at").alias("at"))


def top_grams(grams: DataFrame, *wanted: tuple[int, int, int]) -> DataFrame:
    """The most frequent of each author, first occurrence first among equals: (author, n, rank, gram, c). wanted: (n, how
    many, at least so often)."""
    order = Window.partitionBy("author", "n").orderBy(F.desc("c"), "at")
    often, few = F.lit(False), F.lit(False)
    for n, k, least in wanted:
        often, few = often | ((F.col("n") == n) & (F.col("c") >= least)), few | ((F.col("n") == n) & (F.col("rank") <= k))
    ranked = grams.filter(often).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= max(k for _, k, _ in wanted))
    return ranked.filter(few).select("author", "n", "rank", "gram", "c")


def tone_notes(avg_sentence: Column, contraction: Column, formality: Column, first: Column, question: Column, dash: Column, semicolon: Column, richness: Column) -> Column:
    t = lx.TONE
    return F.array_compact(
        F.array(
            F.when(avg_sentence < 12, t["short"]).when(avg_sentence > 22, t["long"]).otherwise(t["moderate"]),
            F.when(contraction >= lx.FREQUENT, t["frequent"]).when(contraction < lx.RARE, t["rare"]).otherwise(t["some"]),
            F.when(formality > lx.TONE_FORMAL, t["formal"]).when(formality < lx.TONE_CASUAL, t["casual"]).otherwise(t["balanced"]),
            F.when(first > 0.04, t["first"]),
            F.when(question > 0.12, t["question"]),
            F.when(dash > 0.004, t["dash"]),
            F.when(semicolon > 0.002, t["semicolon"]),
            F.when(richness > lx.VARIED, t["varied"]).when(richness < lx.REPEATED, t["repeated"]),
        )
    )


def summary(p: dict[str, Column]) -> Column:
    """The profile in words."""
    notes = F.transform(F.slice(p["tone_notes"], 1, 4), lambda n: F.concat(tx.capitalize(n), F.lit(".")))
    phrases = F.array_join(F.transform(F.slice(p["signature_phrases"], 1, 4), lambda x: F.concat(F.lit('"'), x, F.lit('"'))), ", ")
    bits = F.concat(
        F.array(
            F.concat(F.lit("Based on "), p["sample_count"], F.when(p["sample_count"] == 1, " sample (").otherwise(" samples ("), p["sample_word_count"], F.lit(" words).")),
            F.concat(F.lit("Typical sentence ~"), tx.half_up(p["avg_sentence_length"]).cast("long"), F.lit(" words.")),
        ),
        notes,
        F.when(F.size(p["signature_phrases"]) > 0, F.array(F.concat(F.lit("Recurring phrases: "), phrases, F.lit(".")))).otherwise(F.array().cast("array<string>")),
    )
    return F.array_join(bits, " ")


def _metrics(n: dict[str, Column]) -> dict[str, Column]:
    """Unrounded rates from an author's sums, which are null without a sample that is not blank."""
    zero = lambda c: F.coalesce(n[c], F.lit(0))
    w = F.greatest(zero("n_w"), F.lit(1))
    s = F.greatest(zero("n_s") - zero("open") + zero("oldest_open"), F.lit(1))
    rate = {k: zero(k) / (s if k in ("questions", "exclamations") else w) for k in COUNTS}
    return rate | {"w": w, "s": s, "sentence": w / s, "formality": tx.clamp(0.5 + (zero("formal") - zero("informal") * 1.4) / s * 0.35)}


def _transitions(has: list[Column]) -> Column:
    return F.slice(F.array_compact(F.array(*[F.when(h, t) for h, t in zip(has, lx.TRANSITIONS, strict=True)])), 1, SHOWN_TRANSITIONS)


def profiles(df: DataFrame) -> DataFrame:
    """One row per author of df (author, ord, text; larger ord is newer): the 18 metrics and `summary`.

    Blank and null samples count in sample_count only. An author with only such gets zeros by the rule that counts of
    words and sentences are at least one in denominators. ord is unique within an author.
    """
    samples = _samples(df)
    e = _edges(samples)
    has = [F.max(f"t{i}").alias(f"t{i}") for i in range(len(lx.TRANSITIONS))]
    names = ["n_w", "n_s", "chars", *COUNTS]
    sums = samples.groupBy("author").agg(*[F.sum(F.col(n).cast("long")).alias(n) for n in names], F.sum(F.col("open").cast("long")).alias("open"), F.min_by(F.col("open").cast("long"), "ord").alias("oldest_open"), *has)
    everyone = df.groupBy("author").agg(F.count("*").cast("int").alias("sample_count"))
    distinct = samples.select("author", F.explode(F.array_distinct("w")).alias("word")).distinct().groupBy("author").agg(F.count("*").alias("distinct_words"))
    top = top_grams(gram_counts(samples, e, (3, 2, 0)), TRIGRAMS, BIGRAMS, OPENERS)
    pick = lambda n: F.expr(f"transform(array_sort(filter(g, x -> x.n = {n})), x -> x.gram)")
    top = top.groupBy("author").agg(F.collect_list(F.struct("n", "rank", "gram")).alias("g"))
    top = top.select("author", F.slice(F.concat(pick(3), pick(2)), 1, PHRASES).alias("signature_phrases"), pick(0).alias("preferred_openers"))
    out = everyone
    for side in (sums, distinct, top, _border_passives(e)):
        out = out.join(side.withColumnRenamed("author", "_a"), F.col("author").eqNullSafe(F.col("_a")), "left").drop("_a")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    rate = _metrics({n: F.col(n) for n in ("n_w", "n_s", "open", "oldest_open", *COUNTS)})
    w, s, sentence, formality = (rate[k] for k in ("w", "s", "sentence", "formality"))
    passive = (zero("passives") + zero("border_passives")) / s
    richness = zero("distinct_words") / w
    none = F.array().cast("array<string>")
    values = {
        "avg_sentence_length": tx.half_up(sentence, 2),
        "avg_word_length": tx.half_up(zero("chars") / w, 2),
        "vocabulary_richness": tx.half_up(richness, 3),
        "contraction_rate": tx.half_up(rate["contractions"], 4),
        "question_rate": tx.half_up(rate["questions"], 3),
        "exclamation_rate": tx.half_up(rate["exclamations"], 3),
        "comma_density": tx.half_up(rate["commas"], 4),
        "semicolon_density": tx.half_up(rate["semicolons"], 4),
        "em_dash_density": tx.half_up(rate["dashes"], 4),
        "first_person_rate": tx.half_up(rate["first_person"], 4),
        "passive_voice_hint": tx.half_up(passive, 3),
        "formality_score": tx.half_up(formality, 3),
        "common_transitions": _transitions([F.col(f"t{i}") for i in range(len(lx.TRANSITIONS))]),
        "signature_phrases": F.coalesce("signature_phrases", none),
        "preferred_openers": F.coalesce("preferred_openers", none),
        "tone_notes": tone_notes(sentence, rate["contractions"], formality, rate["first_person"], rate["questions"], rate["dashes"], rate["semicolons"], richness),
        "sample_word_count": zero("n_w").cast("int"),
        "sample_count": F.col("sample_count"),
    }
    out = out.select("author", *[c.alias(n) for n, c in values.items()])
    return out.withColumn("summary", summary({c: F.col(c) for c in out.columns}))


def for_rewriting(df: DataFrame) -> DataFrame:
    """What rewriting reads of `profiles(df)`, the same values: one pass over the samples and a row an author and task
    shuffled, without n-grams, openers or distinct words. tone_notes are the first two, all that rewriting shows; those are
    always the ones on sentence length and contractions."""
    text = F.col("text")
    t = df.select("author", "ord", F.when(tx.trim(text) != "", text).alias("text"))
    low = [F.contains(F.lower("text"), F.lit(x)).alias(f"t{i}") for i, x in enumerate(lx.TRANSITIONS)]
    is_open = (~text.rlike(ENDED)).cast("long")
    size = lambda c: F.when(text.isNotNull(), F.size(c))
    each = t.select("author", "ord", size(tx.words(text)).alias("n_w"), size(tx.sentences(text)).alias("n_s"), is_open.alias("open"), *counted(text), *low)
    sums = [F.sum(F.col(n).cast("long")).alias(n) for n in ("n_w", "n_s", "open", *COUNTS)]
    # of samples that are not blank, as open is null for others
    oldest = F.min_by("open", F.when(F.col("open").isNotNull(), F.col("ord"))).alias("oldest_open")
    a = each.groupBy("author").agg(F.count("*").cast("int").alias("sample_count"), *sums, oldest, *[F.max(f"t{i}").alias(f"t{i}") for i in range(len(lx.TRANSITIONS))])
    m = _metrics({n: F.col(n) for n in ("n_w", "n_s", "open", "oldest_open", *COUNTS)})
    none = F.lit(0.0)
    return a.select(
        "author",
        tx.half_up(m["sentence"], 2).alias("avg_sentence_length"),
        tx.half_up(m["contractions"], 4).alias("contraction_rate"),
        tx.half_up(m["formality"], 3).alias("formality_score"),
        _transitions([F.col(f"t{i}") for i in range(len(lx.TRANSITIONS))]).alias("common_transitions"),
        F.slice(tone_notes(m["sentence"], m["contractions"], none, none, none, none, none, none), 1, 2).alias("tone_notes"),
        "sample_count",
    )


def scalar_profile(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Sentence length, word length, richness and words of single texts, without a shuffle."""
    t = df.select(F.col(id_col), F.col(text_col).alias("_t")).withColumn("_w", tx.words(F.col("_t"))).withColumn("_s", tx.sentences(F.col("_t")))
    w, s = F.greatest(F.size("_w"), F.lit(1)), F.greatest(F.size("_s"), F.lit(1))
    return t.select(id_col, tx.half_up(w / s, 2).alias("avg_sentence_length"), tx.half_up(tx.letters(F.col("_w")) / w, 2).alias("avg_word_length"), tx.half_up(F.size(F.array_distinct("_w")) / w, 3).alias("vocabulary_richness"), F.size("_w").cast("long").alias("sample_word_count"))
