import os
import random
import time
from types import SimpleNamespace

import pytest
from oracle import against_sql
from pyspark.sql import functions as F

from inkfathom.functions import lexicon as lx
from inkfathom.functions import text as tx
from inkfathom.operators import profile, rewrite
from inkfathom.plans import queries
from inkfathom.sources import shared, store

SF = "/root/testdata/sf0.001"


def one(spark, text, c):
    return spark.createDataFrame([(text,)], "t string").select(c(F.col("t"))).first()[0]


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_its_sql(spark, name):
    ours, theirs = against_sql(spark, name, SF)
    assert ours == theirs and ours[1]


def test_tables_have_their_sizes():
    assert [len(x) for x in (lx.CONTRACTIONS, lx.FIRST_PERSON, lx.FORMAL, lx.INFORMAL, lx.TRANSITIONS)] == [48, 10, 15, 23, 18]
    assert [len(x) for x in (lx.FORMAL_TO_CASUAL, lx.CASUAL_TO_FORMAL, lx.EXPANSIONS, lx.CONTRACTED)] == [31, 23, 34, 31]


@pytest.mark.parametrize(
    "f, text, expected",
    [
        (tx.words, "Don’t stop—I'm OK, it's 3.5x (really).", ["don", "t", "stop", "i'm", "ok", "it's", "3", "5x", "really"]),
        (tx.sentences, "One. Two! Three? e.g. this...ok", ["One.", "Two!", "Three?", "e.g.", "this...ok"]),
        (tx.sentences_kept, "...Hello. 3.14 is pi! last bit", ["Hello.", "3.", "14 is pi!", "last bit"]),
        (rewrite.tidy, "hi e.g. this.  ok example.com Yes. No", "Hi e. G. This. Ok example. Com Yes. No"),
        (rewrite.expanded, "I'm sure it's fine. They won't mind.", "I am sure it is fine. They will not mind."),
        (lambda c: rewrite.tidy(rewrite.contracted(c)), "I will not go. You are not late.", "I'll not go. You're not late."),
        (lambda c: F.array_join(rewrite.split_long(tx.sentences_kept(c), F.lit(4.0)), " "), "We ran down the long road, and we sat near the old tree to rest.", "We ran down the long road,. We sat near the old tree to rest."),
        (lambda c: F.array_join(rewrite.join_short(tx.sentences_kept(c)), " "), "I came. I saw. I won.", "I came, and i saw. I won."),
        (lambda c: tx.count_matches(c, profile.COUNTS["dashes"]), "a---b----c—d", 4),
        (lambda c: tx.count_matches(c, profile.COUNTS["informal"]), "like, you know like,x", 2),
        (lambda c: tx.half_up(F.length(c) * 0 + F.lit(1.005), 2), "x", 1.0),
    ],
)
def test_golden_texts(spark, f, text, expected):
    assert one(spark, text, f) == expected


def test_golden_profile(spark):
    text = "I can't wait! Are you coming? We were invited, and it's super fun."
    p = profile.profiles(spark.createDataFrame([("a", 1, text)], "author string, ord bigint, text string")).first()
    assert (p.avg_sentence_length, p.avg_word_length, p.vocabulary_richness, p.contraction_rate) == (4.33, 3.69, 1.0, 0.1538)
    assert (p.question_rate, p.exclamation_rate, p.comma_density, p.passive_voice_hint, p.formality_score) == (0.333, 0.333, 0.0769, 0.333, 0.337)
    assert p.preferred_openers == ["i can't wait", "are you coming", "we were invited"] and p.signature_phrases == []
    assert p.summary == "Based on 1 sample (13 words). Typical sentence ~4 words. Prefers short, punchy sentences. Natural use of contractions. Leans casual and conversational. Frequently writes in first person."


def test_profile_across_samples(spark):
    """Sentences, n-grams, openers and passives that cross samples, against the same samples as one text."""
    parts = ["so it was", "taken by", "***", "me.", "   ", "A b", "c d. e", "f", "g! the cat sat the cat sat the cat", None, "sat again they were", "been broken"]
    many = spark.createDataFrame([("a", -i, p) for i, p in enumerate(parts)], "author string, ord bigint, text string")
    whole = spark.createDataFrame([("a", 1, "\n\n".join(p for p in parts if p and p.strip()))], "author string, ord bigint, text string")
    a, b = (profile.profiles(x).drop("summary", "sample_count").first() for x in (many, whole))
    assert a == b


def test_passives_across_samples(spark):
    """Runs of been, whole samples of them too, against the same samples as one text."""
    rnd = random.Random(9)
    pieces = ["been", "been been", "Been been been", "is", "was been", "taken", "seen, been", "been.", "they were", "been taken", "  been  ", "x", "foo-been", "(been been", "been, been"]
    rows = [(str(a), -i, rnd.choice(pieces[: 3 if a % 3 == 0 else 15])) for a in range(60) for i in range(rnd.randint(1, 7))]
    many = spark.createDataFrame(rows, "author string, ord bigint, text string")
    texts = {}
    for a, _, t in rows:
        texts.setdefault(a, []).append(t)
    whole = spark.createDataFrame([(a, 1, "\n\n".join(t)) for a, t in texts.items()], "author string, ord bigint, text string")
    x, y = ({r.author: r.passive_voice_hint for r in profile.profiles(t).collect()} for t in (many, whole))
    assert x == y and any(x.values())


def test_profiles_of_blank_and_no_samples(spark):
    schema = "author string, ord bigint, text string"
    p = profile.profiles(spark.createDataFrame([(None, 1, " \n"), (None, 2, None)], schema)).first()
    assert p.sample_count == 2 and p.sample_word_count == 0 and p.preferred_openers == []
    assert profile.profiles(spark.createDataFrame([], schema)).count() == 0


def test_rewrite_without_profile_and_blank(spark):
    drafts = spark.createDataFrame([("a", "In order to utilize it, delve into the data."), ("a", " "), (None, None)], "author string, text string")
    got = {r.text: (r.rewritten, r.notes) for r in rewrite.rewrite(drafts, spark.createDataFrame([], store.PROFILE)).collect()}
    assert got["In order to utilize it, delve into the data."] == ("To use it, look at the data.", [lx.NOTE["filler"], lx.NOTE["general"]])
    assert got[" "] == got[None] == ("", [lx.NOTE["empty"]])


def test_gates(spark):
    rows = [
        ("file", "", "x" * 40, "a.pdf", "application/pdf", 1), ("file", "", "x" * 40, "a.pdf", "", 1), ("file", "", "x" * 40, "a.md", "application/pdf", 1),
        ("form", "", "x" * 39, "", "", 0), ("file", "Untitled sample", "x" * 50_001, "my.essay.v2.txt", None, 100_001), (None, None, None, None, None, None),
    ]
    got = store.gated(spark.createDataFrame(rows, "kind string, title string, content string, file_name string, mime string, bytes bigint").withColumn("source", F.lit(None).cast("string"))).collect()
    assert [r.reason for r in got] == ["file_type", None, None, "too_short", "file_size", "too_short"]
    assert got[4].title == "my.essay.v2" and len(got[4].content) == 50_000 and got[5].title == store.UNTITLED


def test_store(spark, tmp_path):
    s = store.Store(spark, f"file://{tmp_path}/store").create().create()
    assert s.health() and s.profile(spark.createDataFrame([("me",)], "author string")).first().summary == lx.EMPTY_SUMMARY
    new = spark.createDataFrame([("me", i, "json", f"t{i}", "This is a sample, and we are writing it. " * 2, "paste", "", "", 0) for i in range(42)] + [("me", 99, "json", "", "short", "", "", "", 0)], "author string, id bigint, kind string, title string, content string, source string, file_name string, mime string, bytes bigint")
    assert sorted((r.id, r.reason) for r in s.add(new).collect()) == [(40, "full"), (41, "full"), (99, "too_short")]
    assert s.samples().count() == 40
    assert [s.delete("me", x) for x in ("x", "-1", "1.5", "999", "3", "3")] == ["bad_id", "bad_id", "bad_id", "not_found", "ok", "not_found"]
    p = s.profile(spark.createDataFrame([("me",)], "author string")).first()
    assert p.sample_count == 39 and p.name == store.PROFILE_NAME
    r = s.rewrite(spark.createDataFrame([("me", 1, "We utilize it."), ("me", 2, " ")], "author string, id bigint, text string")).collect()
    assert len(r) == 1 and r[0].has_samples and s.table("rewrites").count() == 1


def test_files_with_bad_bytes(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"\xef\xbb\xbfgood " + b"\xff\xfe" + "é".encode() + b" end" * 20)
    (tmp_path / "b.md").write_bytes("fine ünïcode text, long enough to be kept by the gate".encode())
    got = {r.file_name: r for r in store.gated(store.read_files(spark, str(tmp_path), "me")).collect()}
    assert got["a.txt"].content.startswith("good ��é end") and got["a.txt"].title == "a" and got["b.md"].reason is None and got["b.md"].source == "upload"


def test_pasted_and_shown(spark):
    rows = [("me", i, t, c) for i, (t, c) in enumerate([(None, "x" * 40), (" ", "y" * 50), (" T ", "z" * 41), ("short", "z" * 39), ("none", None)])]
    got = store.gated(store.pasted(spark.createDataFrame(rows, "author string, id bigint, title string, content string"))).orderBy("id").collect()
    assert [(r.title, r.source, r.reason) for r in got] == [(store.PASTED, "paste", None), (store.PASTED, "paste", None), ("T", "paste", None)]
    shown = spark.createDataFrame([(1, 7), (2, 5)], "rank bigint, id bigint")
    after = store.prepended(shown, spark.createDataFrame([(8,), (9,)], "id bigint"))
    assert [(r.rank, r.id) for r in after.orderBy("rank").collect()] == [(1, 9), (2, 8), (3, 7), (4, 5)]
    assert [r.id for r in store.found(after, 8).collect()] == [8] and store.found(after, None).count() == store.found(after, 1).count() == 0


def test_database_tables(spark):
    url = "jdbc:derby:memory:inkfathom;create=true"
    rows = spark.createDataFrame([(i, f"text {i}") for i in range(100)], "id bigint, content string")
    store.write_table(rows, url, "samples", driver="org.apache.derby.jdbc.EmbeddedDriver")
    got = store.read_table(spark, url, "samples", key="id", parts=4, driver="org.apache.derby.jdbc.EmbeddedDriver")
    assert got.rdd.getNumPartitions() == 4 and sorted((r[0], r[1]) for r in got.collect()) == [(i, f"text {i}") for i in range(100)]
    for f in (lambda: store.read_table(spark, "", "samples"), lambda: store.write_table(rows, None, "samples")):
        with pytest.raises(ValueError):
            f()


def test_repeated_submission_ids(spark, tmp_path):
    s = store.Store(spark, f"file://{tmp_path}/store").create()
    text = "This is a sample, and it is long enough to be kept. "
    rows = [("me", 5, "json", f"t{i}", text + str(i), "paste", "", "", 0) for i in range(3)] + [("me", None, "json", "n", text, "paste", "", "", 0)]
    new = spark.createDataFrame(rows, "author string, id bigint, kind string, title string, content string, source string, file_name string, mime string, bytes bigint")
    assert s.add(new).count() == 0 and s.add(new.drop("id")).count() == 0
    assert sorted(r.id for r in s.samples().collect()) == list(range(1, 9))


def test_scratch_tables(spark, tmp_path, monkeypatch):
    """Tables go when asked to, folders of dead applications by their age; a cluster without a shared folder is an error."""
    monkeypatch.setattr(shared, "shared_root", lambda spark: f"file://{tmp_path}")
    t = shared.written(spark.range(5), "t")
    folder = next((tmp_path / "inkfathom").iterdir())
    assert t.count() == 5 and len(list(folder.iterdir())) == 1
    shared.dropped(t)
    assert not list(folder.iterdir())
    for name, age in (("app-old", 3), ("app-new", 0)):
        (tmp_path / "inkfathom" / name / "x").mkdir(parents=True)
        os.utime(tmp_path / "inkfathom" / name, (time.time() - age * 86_400,) * 2)
    assert shared.sweep(spark) == 1 and {p.name for p in (tmp_path / "inkfathom").iterdir()} == {folder.name, "app-new"}
    monkeypatch.undo()
    none = SimpleNamespace(get=lambda *a: None)
    with pytest.raises(ValueError):
        shared.shared_root(SimpleNamespace(conf=none, sparkContext=SimpleNamespace(master="yarn", getConf=lambda: none)))


@pytest.mark.parametrize("name", ["rewrite_notes", "rewrite_full"])
def test_rewriting_counts_no_ngrams(spark, monkeypatch, name):
    """Rewriting reads nothing of a profile that n-grams, openers or distinct words are needed for."""
    monkeypatch.setattr(profile, "gram_counts", lambda *a: pytest.fail("n-grams are counted"))
    assert queries.QUERIES[name](spark, SF).count() == spark.read.parquet(f"{SF}/documents.parquet").count()


def test_profiles_for_rewriting(spark):
    r = random.Random(5)
    bits = ["However,", "I'm", "gonna", "it's.", "on the other hand", "therefore", "word", "Yes!", "\n\n", "so. ", "?", "ch\u00e9 ", "like, "]
    texts = [" ".join(r.choice(bits) for _ in range(r.randrange(1, 30))) for _ in range(60)] + [None, " \n", "", "\u00a0"]
    rows = [(r.choice(["a", "b", None]), i, t) for i, t in enumerate(texts)] + [("blank", 1, None), ("blank", 2, " \t")]
    df = spark.createDataFrame(rows, "author string, ord bigint, text string")
    whole = profile.profiles(df).select("author", *rewrite.READ).withColumn("tone_notes", F.slice("tone_notes", 1, 2))
    got = profile.for_rewriting(df).select("author", *rewrite.READ)
    assert sorted(map(repr, got.collect())) == sorted(map(repr, whole.collect())) and got.count() == 4


def test_text_functions_as_plain_patterns(spark):
    """Rules, counts and splitters give what their plain patterns give, on text of terms, odd white space and odd letters."""
    r = random.Random(9)
    lists = (lx.FORMAL_TO_CASUAL, lx.CASUAL_TO_FORMAL, lx.CONTRACTED, lx.EXPANSIONS, lx.FILLER)
    bits = [a.split("(?:")[0].rstrip() for rules in lists for a, _ in rules] + ["In today's digital world,", "In summary", "navigate the landscape", "like,", "end", "so", "_", "9"]
    glue = [" ", " ", "  ", "\n", "\n\n", ". ", ".\n", "!", "? ", ", ", "\u2028", "\u3000 ", "\u00a0", "-", "'", "\u0130", "\u212a", "\u00df", "\x00", "\x1f", "\U0001f600", ".\u2029", ", and "]
    case = [str.lower, str.upper, str.title, str]
    texts = ["", " \n", "...", None] + ["".join(r.choice(case)(r.choice(bits)) + r.choice(glue) for _ in range(r.randrange(1, 40))) for _ in range(400)]
    c, ws = F.col("t"), tx.WS

    def plain(rules):
        t = c
        for a, b in rules:
            end = r"(?![A-Za-z0-9_])" if a[-1].isalnum() or a[-1] in "_)" else "(?=[A-Za-z0-9_])"
            t = F.regexp_replace(t, ("" if a.startswith(("I'", "I ")) else "(?i)") + r"(?<![A-Za-z0-9_])" + a + end, b)
        return t

    trim = lambda x: F.regexp_replace(x, rf"^[{ws}]+|[{ws}]+\z", "")
    full = lambda x: F.filter(x, lambda y: y != "")
    kept = F.regexp_extract_all(c, F.lit(r"[^.!?]+[.!?]+|[^.!?]+\z"), 0)
    pairs = {
        "trim": (tx.trim(c), trim(c)),
        "words": (tx.words(c), full(F.split(F.regexp_replace(F.lower(c), rf"[^a-z0-9'{ws}-]", " "), rf"[{ws}]+"))),
        "word_count": (tx.word_count(c), F.size(full(F.split(trim(c), rf"[{ws}]+")))),
        "sentences": (tx.sentences(c), full(F.transform(F.split(c, rf"(?<=[.!?])[{ws}]+"), trim))),
        "kept": (tx.sentences_kept(c), F.when(F.size(kept) == 0, F.array(trim(c))).otherwise(full(F.transform(kept, trim)))),
        "closed": (rewrite.closed_up(c), F.regexp_replace(F.regexp_replace(c, rf"[{ws}]{{2,}}", " "), rf"[{ws}]+([,.!?;:])", "$1")),
        "start": (tx.trimmed_start(c, 45), F.left(trim(c), F.lit(45))),
        **{f"rules{i}": (rewrite.replaced(c, rules), plain(rules)) for i, rules in enumerate(lists)},
        **{k: (tx.count_matches(c, tx.any_of(v)), tx.count_matches(c, r"(?i)(?<![A-Za-z0-9_])(?:" + "|".join(t + (r"(?![A-Za-z0-9_])" if t[-1].isalnum() else "(?=[A-Za-z0-9_])") for t in v) + ")")) for k, v in (("contractions", lx.CONTRACTIONS), ("informal", lx.INFORMAL), ("formal", lx.FORMAL), ("first", lx.FIRST_PERSON))},
    }
    df = spark.createDataFrame([(t,) for t in texts], "t string").repartition(4).persist()
    for name, (ours, theirs) in pairs.items():
        wrong = df.select("t", ours.alias("ours"), theirs.alias("theirs")).filter(~F.col("ours").eqNullSafe(F.col("theirs"))).collect()
        assert not wrong, (name, wrong[0])
    df.unpersist()


def test_long_runs_of_white_space(spark):
    """A long run inside a text is not searched again from each of its places."""
    text, began = "word " + " \u00a0" * 250_000 + "more" + " " * 250_000, time.time()
    row = store.gated(spark.createDataFrame([("json", "T", text), ("json", "T", "x" * 39 + " \n" * 100_000)], "kind string, title string, content string").withColumns({c: F.lit("") for c in ("source", "file_name", "mime")}).withColumn("bytes", F.lit(0))).collect()
    assert [(len(x.content), x.word_count, x.reason) for x in row] == [(50_000, 1, None), (39, 1, "too_short")] and time.time() - began < 30


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0 and set(entry.oracle_sql()) <= set(entry.queries())
