"""Samples, profiles and rewrites: ingest gates as columns, and a store of append-only tables.

Submissions come from text files, JSON lines, pasted texts, or a table of a database over JDBC.

A batch of submissions is gated as a whole; what fails goes to quarantine with its reason. The store keeps samples,
tombstones, profile versions and the rewrite log as parquet, so that writers only ever append.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import lexicon as lx
from ..functions import text as tx
from ..operators import profile, rewrite
from .shared import dropped, file_system, running, written

SAMPLES = "author string, id bigint, title string, content string, word_count int, source string, created_at timestamp, updated_at timestamp"
DELETED = "author string, id bigint"
REWRITES = "author string, id bigint, original_text string, rewritten_text string, notes string, created_at timestamp"
PROFILE = (
    "author string, avg_sentence_length double, avg_word_length double, vocabulary_richness double, contraction_rate double, question_rate double, exclamation_rate double, comma_density double, "
    "semicolon_density double, em_dash_density double, first_person_rate double, passive_voice_hint double, formality_score double, common_transitions array<string>, signature_phrases array<string>, "
    "preferred_openers array<string>, tone_notes array<string>, sample_word_count int, sample_count int, summary string"
)
PROFILES = PROFILE + ", name string, updated_at timestamp"
UNTITLED, UPLOADED, PASTED, PROFILE_NAME = "Untitled sample", "Uploaded sample", "Pasted sample", "My writing style"
#: An author's profile before the first sample.
EMPTY = dict(avg_sentence_length=16.0, avg_word_length=4.5, vocabulary_richness=0.5, contraction_rate=0.02, question_rate=0.05, exclamation_rate=0.02, comma_density=0.05, semicolon_density=0.0, em_dash_density=0.0, first_person_rate=0.03, passive_voice_hint=0.05, formality_score=0.5)


def gated(df: DataFrame) -> DataFrame:
    """Submissions (kind, title, content, source, file_name, mime, bytes and any others) with title, content, source and
    word_count as they would be stored, and `reason`: null, file_type, file_size or too_short.

    kind is json, file or form; anything else and null are form. Null strings are empty. The reasons are tested in that
    order; lengths count code points.
    """
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    is_file, is_json = F.coalesce(F.col("kind") == "file", F.lit(False)), F.coalesce(F.col("kind") == "json", F.lit(False))
    asked = F.left(tx.trim(text("title")), F.lit(lx.MAX_TITLE))
    name = F.when(text("file_name") == "", "upload.txt").otherwise(F.col("file_name"))
    stem = F.left(F.regexp_replace(name, r"\.[^.]+\z", ""), F.lit(lx.MAX_TITLE))
    unset = (asked == "") | (asked == UNTITLED)
    title = F.when(is_file & unset, F.when(stem == "", UPLOADED).otherwise(stem)).when(asked == "", UNTITLED).otherwise(asked)
    plain = F.lower(name).rlike(r"\.(txt|md|markdown|text)\z")
    bad_type = is_file & ~plain & (text("mime") != "") & ~text("mime").startswith("text/")
    content = F.when(is_file, F.replace(text("content"), F.lit("\0"), F.lit(""))).otherwise(text("content"))
    stored = tx.let(content, lambda c: tx.trimmed_start(c, lx.MAX_CHARS))
    reason = F.when(bad_type, "file_type").when(is_file & (F.coalesce(F.col("bytes"), F.lit(0)) > lx.MAX_BYTES), "file_size").when(F.length("_stored") < lx.MIN_CHARS, "too_short")
    source = F.when(is_file | (is_json & (text("source") == "upload")), "upload").otherwise("paste")
    columns = {"title": title, "content": F.col("_stored"), "source": source, "word_count": tx.word_count(F.col("_stored")).cast("int"), "reason": reason}
    return tx.settled(df.withColumn("_stored", stored)).select(*[c for c in df.columns if c not in columns], *[c.alias(n) for n, c in columns.items()])


def within_capacity(accepted: DataFrame, existing: DataFrame, order: str, most: int = lx.MAX_SAMPLES) -> DataFrame:
    """accepted (author, order and others) with `over`: whether its author's store of `most` samples (existing: author, n)
    is full when its turn comes. Only the first `most` of each author are ranked (the rest are over at once)."""
    counts = existing.select(F.col("author").alias("_a"), F.col("n").alias("_n"))
    joined = accepted.join(counts, F.col("author").eqNullSafe(F.col("_a")), "left").drop("_a")
    first = joined.withColumn("_r", F.row_number().over(Window.partitionBy("author").orderBy(order))).filter(F.col("_r") <= most)
    turn = first.filter(F.col("_r") + F.coalesce("_n", F.lit(0)) <= most).select(F.col("author").alias("_a"), F.col(order).alias("_o"), F.lit(False).alias("_in"))
    out = joined.join(turn, F.col("author").eqNullSafe(F.col("_a")) & (F.col(order) == F.col("_o")), "left")
    return out.select(*accepted.columns, F.col("_in").isNull().alias("over"))


def read_files(spark: SparkSession, path: str, author: str) -> DataFrame:
    """Text files below path as submissions. Bytes that are no UTF-8 become replacement characters, as in a browser."""
    raw = spark.read.format("binaryFile").load(path)
    name = F.element_at(F.split("path", "/"), -1)
    text = F.regexp_replace(F.make_valid_utf8(F.col("content").cast("string")), "^\ufeff", "")
    return raw.select(F.lit(author).alias("author"), F.lit("file").alias("kind"), F.lit("").alias("title"), text.alias("content"), F.lit("upload").alias("source"), name.alias("file_name"), F.lit("").alias("mime"), F.col("length").alias("bytes"))


def read_json(spark: SparkSession, path: str, author: str) -> DataFrame:
    """JSON lines {title, content, source} as submissions."""
    raw = spark.read.schema("title string, content string, source string").json(path)
    return raw.select(F.lit(author).alias("author"), F.lit("json").alias("kind"), "title", "content", "source", F.lit("").alias("file_name"), F.lit("").alias("mime"), F.lit(0).cast("long").alias("bytes"))


def pasted(df: DataFrame) -> DataFrame:
    """Pasted texts (author, title, content) as submissions: a blank title is PASTED; texts too short to be sent are left out."""
    title = tx.trim(F.coalesce("title", F.lit("")))
    sent = df.filter(F.length(tx.trim(F.coalesce("content", F.lit("")))) >= lx.MIN_CHARS)
    rest = [c for c in df.columns if c not in ("kind", "title", "source", "file_name", "mime", "bytes")]
    return sent.select(*rest, F.lit("json").alias("kind"), F.when(title == "", PASTED).otherwise(title).alias("title"), F.lit("paste").alias("source"), F.lit("").alias("file_name"), F.lit("").alias("mime"), F.lit(0).cast("long").alias("bytes"))


def read_table(spark: SparkSession, url: str | None, table: str, key: str | None = None, parts: int = 1, **options: str) -> DataFrame:
    """A database table over JDBC. With a key (a whole-number column) it is read in `parts` ranges of the key, whose bounds
    the database gives; so a large table is as many tasks. No url is an error, at once."""
    if not url:
        raise ValueError("a JDBC url is required")
    reader = spark.read.format("jdbc").options(url=url, **options)
    if key and parts > 1:
        quoted = spark.sparkContext._jvm.org.apache.spark.sql.jdbc.JdbcDialects.get(url).quoteIdentifier(key)
        low, high = reader.option("query", f"SELECT MIN({quoted}) AS lo, MAX({quoted}) AS hi FROM {table}").load().first()
        if low is not None:
            reader = spark.read.format("jdbc").options(url=url, **options).options(partitionColumn=key, lowerBound=int(low), upperBound=int(high) + 1, numPartitions=parts)
    return reader.option("dbtable", table).load()


def write_table(df: DataFrame, url: str | None, table: str, **options: str) -> None:
    """Appends df to a database table over JDBC."""
    if not url:
        raise ValueError("a JDBC url is required")
    df.write.format("jdbc").options(url=url, dbtable=table, **options).mode("append").save()


def prepended(listed_samples: DataFrame, new: DataFrame) -> DataFrame:
    """A shown list (rank and others) with new samples (without rank) before it, the newest identifier first."""
    n = new.count()
    own = running(new.withColumn("_one", F.lit(1).cast("long")), [F.desc("id")], {"rank": "_one"}).withColumn("rank", F.col("rank") + 1).drop("_one")
    return own.unionByName(listed_samples.withColumn("rank", F.col("rank") + n))


def found(listed_samples: DataFrame, sample_id: int | None) -> DataFrame:
    """The sample of that identifier, or no row."""
    return listed_samples.filter(F.col("id") == F.lit(sample_id))


def latest(profiles: DataFrame) -> DataFrame:
    """Each author's newest profile version."""
    whole = F.struct(*profiles.columns)
    return profiles.groupBy(F.col("author").alias("_a")).agg(F.max_by(whole, "updated_at").alias("p")).select("p.*")


def listed(samples: DataFrame) -> DataFrame:
    """Newest first; the identifier decides between equal times."""
    return samples.orderBy(F.desc("created_at"), F.desc("id"))


def empty_profiles(authors: DataFrame) -> DataFrame:
    none = F.array().cast("array<string>")
    fixed = [F.lit(v).alias(k) for k, v in EMPTY.items()]
    return authors.select("author", *fixed, *[none.alias(c) for c in ("common_transitions", "signature_phrases", "preferred_openers")], F.array(F.lit(lx.EMPTY_TONE)).alias("tone_notes"), F.lit(0).alias("sample_word_count"), F.lit(0).alias("sample_count"), F.lit(lx.EMPTY_SUMMARY).alias("summary"))


class Store:
    """The tables below one folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._kinds = {"samples": SAMPLES, "deleted": DELETED, "profiles": PROFILES, "rewrites": REWRITES}

    def create(self) -> Store:
        """Makes the tables that are missing."""
        for name, schema in self._kinds.items():
            fs, p = file_system(self.spark, f"{self.root}/{name}")
            if not fs.exists(p):
                self.spark.createDataFrame([], schema).write.mode("ignore").parquet(f"{self.root}/{name}")
        return self

    def table(self, name: str) -> DataFrame:
        return self.spark.read.schema(self._kinds[name]).parquet(f"{self.root}/{name}")

    def _append(self, name: str, df: DataFrame) -> None:
        columns = [c.split()[0] for c in self._kinds[name].split(", ")]
        df.select(*columns).write.mode("append").parquet(f"{self.root}/{name}")

    def samples(self) -> DataFrame:
        return self.table("samples").join(self.table("deleted"), ["author", "id"], "left_anti")

    def health(self) -> bool:
        return self.spark.sql("SELECT 1 AS ok").first().ok == 1

    def add(self, submissions: DataFrame) -> DataFrame:
        """Stores what passes the gates and fits, rebuilds its authors' profiles, and gives the rejected with reasons.

        submissions: author, and the columns of gated(). They count in the order of an `id` column, if there is one, and
        get identifiers that follow the store's, one each; repeated and null ids are allowed."""
        top = self.table("samples").agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
        g = gated(submissions)
        g = g if "id" in g.columns else g.withColumn("id", F.lit(None).cast("long"))
        order = [F.asc_nulls_last("id"), F.asc("author"), F.xxhash64("title", "content")]
        g = written(running(g.withColumn("_one", F.lit(1).cast("long")), order, {"_nr": "_one"}).drop("_one"), "batch")
        counts = self.samples().groupBy("author").agg(F.count("*").alias("n"))
        good = written(within_capacity(g.filter("reason IS NULL"), counts, "_nr"), "accepted")
        now = F.current_timestamp()
        fresh = good.filter("NOT over").withColumn("id", F.lit(top + 1) + F.col("_nr")).withColumn("created_at", now).withColumn("updated_at", now)
        rejected = written(g.filter("reason IS NOT NULL").select("author", "id", "reason").unionByName(good.filter("over").select("author", "id", F.lit("full").alias("reason"))), "rejected")
        self._append("samples", fresh)
        self.rebuild(g.select("author").distinct())
        dropped(g, good)
        return rejected

    def delete(self, author: str, sample_id: str) -> str:
        """ok, bad_id or not_found, by the identifier as it came."""
        try:
            number = float(sample_id)
        except ValueError:
            return "bad_id"
        if not 0 < number < float("inf") or number != int(number):
            return "bad_id"
        if not self.samples().filter((F.col("author") == author) & (F.col("id") == int(number))).limit(1).count():
            return "not_found"
        self._append("deleted", self.spark.createDataFrame([(author, int(number))], DELETED))
        self.rebuild(self.spark.createDataFrame([(author,)], "author string"))
        return "ok"

    def rebuild(self, authors: DataFrame) -> None:
        """New profile versions for the authors, from all their samples; names are kept."""
        mine = self.samples().join(authors, "author", "left_semi")
        made = profile.profiles(mine.select("author", F.col("id").alias("ord"), F.col("content").alias("text")))
        bare = empty_profiles(authors.join(mine.select("author").distinct(), "author", "left_anti"))
        names = latest(self.table("profiles")).select(F.col("author").alias("_a"), F.col("name"))
        rows = made.unionByName(bare).join(names, F.col("author").eqNullSafe(F.col("_a")), "left").withColumn("name", F.coalesce("name", F.lit(PROFILE_NAME))).withColumn("updated_at", F.current_timestamp())
        self._append("profiles", rows)

    def profile(self, authors: DataFrame) -> DataFrame:
        """The newest profile of each of the authors, made first where there is none."""
        missing = authors.join(self.table("profiles").select("author").distinct(), "author", "left_anti")
        if missing.limit(1).count():
            self.rebuild(missing)
        return latest(self.table("profiles")).join(authors, "author", "left_semi")

    def rewrite(self, drafts: DataFrame) -> DataFrame:
        """Rewrites drafts (author, id, text), logs them and gives id, rewritten, notes, summary and has_samples; blank drafts are left out."""
        p = self.profile(drafts.select("author").distinct())
        done = rewrite.rewrite(drafts.filter(tx.trim(F.coalesce("text", F.lit(""))) != ""), p)
        self._append("rewrites", done.select("author", "id", F.col("text").alias("original_text"), F.col("rewritten").alias("rewritten_text"), F.array_join("notes", "\n").alias("notes"), F.current_timestamp().alias("created_at")))
        about = p.select(F.col("author").alias("_a"), "summary", (F.col("sample_count") > 0).alias("has_samples"))
        return done.join(about, F.col("author").eqNullSafe(F.col("_a")), "left").select("id", "rewritten", "notes", "summary", "has_samples")
