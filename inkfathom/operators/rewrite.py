"""Rule-based rewriting of drafts toward a profile: ordered replacements, sentence rhythm, transitions, tidying.

Each step is a column expression over the one before; `staged` puts steps into columns of their own, so that a long chain
is evaluated once where several later expressions read it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexicon as lx
from ..functions import text as tx


#: A rule as it is run: what its matches begin with (lower case), its pattern without and with the border before, and what
#: is put in their place.
Rule = tuple[str, str, str, str]


def _rule(term: str, by: str) -> Rule:
    """A term that starts with I keeps its case where it is the pronoun."""
    return tx.literal_start(term), term + tx.ending(term), tx.bounded(term, case=term.startswith(("I'", "I "))), by


def _in_order(c: Column, rules: list[Rule]) -> Column:
    """The rules in order, each on the last one's result.

    A text that no rule matches is left after one search for all of them. Else a rule's pattern is only run on a text that
    has, in lower case, what its matches begin with. The state is the text with its lower-case form.
    """
    both = lambda t: F.struct(t.alias("t"), F.lower(t).alias("low"))
    table = F.array(*[F.struct(F.lit(k).alias("key"), F.lit(p).alias("find"), F.lit(b).alias("put")) for k, _, p, b in rules])
    step = lambda s, r: F.when(F.contains(s["low"], r["key"]), tx.let(F.regexp_replace(s["t"], r["find"], r["put"]), both)).otherwise(s)
    ruled = lambda t: F.aggregate(table, both(t), step, lambda s: s["t"])
    return tx.let(c, lambda t: F.when(t.rlike(tx.within([p for _, p, _, _ in rules])), ruled(t)).otherwise(t))


def replaced(c: Column, rules: list[tuple[str, str]]) -> Column:
    return _in_order(c, [_rule(*r) for r in rules])


def closed_up(c: Column) -> Column:
    """Runs of two or more white space become a space; none stays before punctuation."""
    return F.regexp_replace(F.regexp_replace(c, rf"{tx.SPACE}{{2,}}", " "), rf"{tx.SPACE}+([,.!?;:])", "$1")


def apply_rules(c: Column, rules: list[tuple[str, str]]) -> Column:
    return closed_up(replaced(c, rules))


def without_filler(c: Column) -> Column:
    prefixes = [(tx.literal_start(p), p, rf"(?i){tx.starting(p)}{tx.SPACE}*", "") for p in lx.FILLER_PREFIXES]
    return closed_up(_in_order(c, prefixes + [_rule(*r) for r in lx.FILLER]))


def casual(c: Column) -> Column:
    return apply_rules(c, lx.FORMAL_TO_CASUAL)


def formal(c: Column) -> Column:
    return apply_rules(c, lx.CASUAL_TO_FORMAL)


def general(c: Column) -> Column:
    return apply_rules(c, lx.FORMAL_TO_CASUAL[: lx.GENERAL_RULES])


def contracted(c: Column) -> Column:
    return apply_rules(c, lx.CONTRACTED)


def expanded(c: Column) -> Column:
    return apply_rules(c, lx.EXPANSIONS)


def tidy(c: Column) -> Column:
    """Closed up; a lower-case letter after an end mark becomes upper-case, one space apart; so does the first letter."""
    parts = F.split(closed_up(c), rf"(?<=[.!?])[{tx.WS}]*(?=[a-z])")
    t = F.array_join(F.transform(parts, lambda x, i: F.when(i > 0, tx.capitalize(x)).otherwise(x)), " ")
    head = F.regexp_extract(t, rf"^[{tx.WS}]*[a-z]", 0)
    t = F.concat(F.upper(head), F.substr(t, F.length(head) + 1))
    return tx.trim(t)


def n_words(c: Column) -> Column:
    return F.size(tx.words(c))


def split_long(sentences: Column, target: Column) -> Column:
    """Sentences of more than target + 4 words, cut at conjunctions; pieces get an end mark and a capital."""
    pattern = rf"(?i){tx.SPACE}+(?:, and|and|, but|but|;){tx.SPACE}+"

    def ended(p: Column) -> Column:
        return tx.let(tx.trim(p), lambda x: tx.capitalize(F.when(x.rlike(r"[.!?]\z"), x).otherwise(F.concat(x, F.lit(".")))))

    def cut(s: Column) -> Column:
        # split compiles its pattern for each sentence, so those without a cut are told apart first
        return F.when(s.rlike(pattern) & (n_words(s) > target + 4), F.transform(F.split(s, pattern), ended)).otherwise(F.array(s))

    return F.flatten(F.transform(sentences, cut))


def join_short(sentences: Column) -> Column:
    """Short neighbours joined in pairs, left to right: in each run of places that may join, every second one does.

    Words are counted once a sentence. One pass over the array; the state is the result so far and the sentence not yet
    placed.
    """
    counted = F.transform(sentences, lambda x: F.struct(x.alias("t"), n_words(x).alias("n")))
    nothing = F.lit(None).cast("struct<t: string, n: int>")
    empty = F.struct(F.array().cast("array<string>").alias("out"), nothing.alias("held"))

    def step(s: Column, nxt: Column) -> Column:
        cur = s["held"]
        fits = cur.isNotNull() & (cur["n"] < 10) & (nxt["n"] < 14) & ~cur["t"].rlike(r"\?\z")
        joined = F.concat(F.regexp_replace(cur["t"], r"[.!]\z", ""), F.lit(", and "), tx.decapitalize(nxt["t"]))
        return F.when(fits, F.struct(F.concat(s["out"], F.array(joined)).alias("out"), nothing.alias("held"))).otherwise(
            F.struct(F.when(cur.isNotNull(), F.concat(s["out"], F.array(cur["t"]))).otherwise(s["out"]).alias("out"), nxt.alias("held"))
        )

    return F.aggregate(counted, empty, step, lambda s: F.when(s["held"].isNotNull(), F.concat(s["out"], F.array(s["held"]["t"]))).otherwise(s["out"]))


def rhythm(c: Column, target: Column) -> Column:
    def tuned(s: Column) -> Column:
        split, joined = F.array_join(split_long(s, target), " "), F.array_join(join_short(s), " ")
        return tx.let(n_words(c) / F.greatest(F.size(s), F.lit(1)), lambda mean: F.when(mean > target + 6, split).when((mean < target - 6) & (F.size(s) > 1), joined).otherwise(c))

    return tx.let(tx.sentences_kept(c), tuned)


def woven(c: Column, transition: Column) -> Column:
    """The transition before the second of at least three sentences, unless the text has it already; else null."""

    def put(s: Column) -> Column:
        new = F.transform(s, lambda x, i: F.when(i == 1, F.concat(tx.capitalize(transition), F.lit(", "), tx.decapitalize(x))).otherwise(x))
        return F.when(F.size(s) >= 3, F.array_join(new, " "))

    return F.when((transition != "") & ~F.contains(F.lower(c), transition), tx.let(tx.sentences_kept(c), put))


def staged(df: DataFrame, name: str, c: Column) -> DataFrame:
    return tx.settled(df.withColumn(name, c))


#: What rewriting reads of a profile.
READ = ("avg_sentence_length", "contraction_rate", "formality_score", "common_transitions", "tone_notes", "sample_count")


def rewrite(drafts: DataFrame, profiles: DataFrame, text_col: str = "text") -> DataFrame:
    """drafts (author, text and others) with `rewritten` and `notes`; profiles as profile.profiles gives them.

    Authors without a profile, or with one of no samples, get the general rules. Blank and null drafts give an empty text
    and one note. Profiles are joined by author; extra columns of drafts stay, but not those named like the results.
    """
    keep = [c for c in drafts.columns if c not in ("rewritten", "notes")]
    p = profiles.select(F.col("author").alias("_author"), *[F.col(c).alias(f"_p_{c}") for c in READ])
    d = drafts.select(*keep).join(p, F.col("author").eqNullSafe(F.col("_author")), "left").drop("_author")
    known = F.coalesce(F.col("_p_sample_count"), F.lit(0)) > 0
    score, rate = F.col("_p_formality_score"), F.col("_p_contraction_rate")
    d = staged(d, "_in", tx.trim(F.coalesce(F.col(text_col), F.lit(""))))
    d = staged(d, "_plain", without_filler(F.col("_in")))
    d = staged(d, "_register", F.when(~known, general(F.col("_plain"))).when(score < lx.REWRITE_CASUAL, casual(F.col("_plain"))).when(score > lx.REWRITE_FORMAL, formal(F.col("_plain"))).otherwise(F.col("_plain")))
    d = staged(d, "_forms", F.when(~known, F.col("_register")).when(rate >= lx.FREQUENT, contracted(F.col("_register"))).when(rate < lx.RARE, expanded(F.col("_register"))).otherwise(F.col("_register")))
    d = staged(d, "_timed", F.when(known, rhythm(F.col("_forms"), F.col("_p_avg_sentence_length"))).otherwise(F.col("_forms")))
    first = F.try_element_at("_p_common_transitions", F.lit(1))
    d = staged(d, "_woven", F.when(known & (score >= 0.5) & first.isNotNull(), woven(F.col("_timed"), first)))
    notes = F.array_compact(
        F.array(
            F.when(F.col("_plain") != F.col("_in"), lx.NOTE["filler"]),
            F.when(~known, lx.NOTE["general"]).when(score < lx.REWRITE_CASUAL, lx.NOTE["casual"]).when(score > lx.REWRITE_FORMAL, lx.NOTE["formal"]).otherwise(lx.NOTE["balanced"]),
            F.when(known & (rate >= lx.FREQUENT), lx.NOTE["contract"]).when(known & (rate < lx.RARE), lx.NOTE["expand"]),
            F.when(F.col("_timed") != F.col("_forms"), F.concat(F.lit("Tuned sentence rhythm toward ~"), tx.half_up(F.col("_p_avg_sentence_length")).cast("long"), F.lit(" words"))),
            F.when(F.col("_woven").isNotNull(), F.concat(F.lit("Wove in a transition you often use (“"), first, F.lit("”)"))),
        )
    )
    cues = F.when(known, F.transform(F.slice("_p_tone_notes", 1, 2), lambda n: F.concat(F.lit("Style cue: "), n))).otherwise(F.array().cast("array<string>"))
    blank = F.col("_in") == ""
    return d.select(*keep, F.when(blank, "").otherwise(tidy(F.coalesce("_woven", "_timed"))).alias("rewritten"), F.when(blank, F.array(F.lit(lx.NOTE["empty"]))).otherwise(F.concat(notes, cues)).alias("notes"))
