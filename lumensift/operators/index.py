"""The inverted index as ordinary tables.

postings(term, doc_idx, tf_title, tf_keywords, tf_body), terms(term, df, first_pos), forms(term, word, first_pos),
doc_stats(doc_idx, doc_len), typos (see typos.py) and the corpus numbers. first_pos, a (doc_idx, field, position) struct, is where a term or form was first
seen; that order is what suggestions, typo repair and highlighting go by.

Words are counted document by document (split.py), and only the distinct words are stemmed. An index that is not saved keeps these counts and the small
tables; a search takes the counts of its words alone, and all postings are joined from counts and stems only where all are asked for. A saved index has the counts with their
terms (staged), which its postings are sums of.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field, replace
from functools import cached_property

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumensift.functions import split
from lumensift.functions import text as X
from lumensift.operators import phrases
from lumensift.operators import typos as T
from lumensift.schema import EngineConfig, small

FIELDS = ("title", "keywords", "body")


def occurrences(docs: DataFrame, together: bool = False) -> DataFrame:
    """(doc_idx, field, pos, word) of each indexed word. field: 0 title, 1 keywords, 2 body; pos counts all words of the field. together: dealt by
    document, so that all rows of a document are in one task."""
    docs = X.normalised(docs.select("doc_idx", "title", "keywords_text", "content"), "title", "keywords_text", "content")
    docs = docs.repartition("doc_idx") if together else docs
    texts = F.array(F.coalesce("title", F.lit("")), F.coalesce("keywords_text", F.lit("")), F.coalesce("content", F.lit("")))
    fields = docs.select("doc_idx", F.posexplode(texts).alias("field", "text"))
    # outer, as else Spark first filters by the size of what is exploded, and so finds all words twice; a null is no word below
    found = fields.select("doc_idx", "field", F.posexplode_outer(X.words_of(F.col("text"))).alias("pos", "word"))
    return found.where(~X.is_stop_word(F.col("word")))


@dataclass(frozen=True)
class SearchIndex:
    docs: DataFrame
    postings: DataFrame
    terms: DataFrame
    forms: DataFrame
    doc_stats: DataFrame
    config: EngineConfig = field(default_factory=EngineConfig)
    counted: tuple[int, float] | None = None  #: the corpus numbers of a saved index
    staged: DataFrame | None = None  #: counts by word and document with terms, which the tables of a saved index come from
    typos: DataFrame | None = None  #: parts of terms for config.levenshtein_limit edits
    positions: DataFrame | None = None  #: places of words, of an index that was saved with them
    counts: DataFrame | None = None  #: counts by word and document of an index that is not saved; they are kept, in the place of the tables as long as they

    @cached_property
    def corpus(self) -> tuple[int, float]:
        """Number of documents, and the mean length of their bodies (0 if there are none)."""
        if self.counted is not None:
            return self.counted
        row = self.doc_stats.agg(F.count("*").alias("n"), F.sum("doc_len").alias("total")).first()
        return row["n"], (row["total"] / row["n"] if row["n"] else 0.0)

    def dictionary(self) -> DataFrame:
        return self.terms.select("term", "first_pos").orderBy("first_pos").select("term")

    def of_terms(self, terms: Iterable[str]) -> DataFrame:
        """The postings of a few terms. Those of an index that is not saved come from the counts of their words."""
        if self.counts is None:
            return self.postings.where(F.col("term").isin(*terms))
        words = [tuple(r) for r in self.forms.where(F.col("term").isin(*terms)).select("word", "term").collect()]
        named = small(self.forms.sparkSession, words, "word string, term string")
        return postings(self.counts.where(F.col("word").isin(*(w for w, _ in words))).join(F.broadcast(named), "word"))

    def known(self) -> DataFrame:
        """(term) of all terms."""
        return self.terms.select("term") if self.counts is None else self.forms.select("term").distinct()

    def typos_within(self, limit: int) -> DataFrame:
        """Parts of terms for look-ups within so many edits."""
        kept = self.typos is not None and limit == self.config.levenshtein_limit
        return self.typos if kept else T.entries(self.terms.select("term", "first_pos"), limit)

    @property
    def _tables(self) -> list[DataFrame]:
        """What others come from first."""
        if self.counts is not None:
            return [df for df in (self.counts, self.forms, self.terms, self.doc_stats, self.typos) if df is not None]
        return [df for df in (self.staged, self.postings, self.terms, self.forms, self.doc_stats, self.typos) if df is not None]

    def persist(self) -> SearchIndex:
        for df in self._tables:
            df.persist(StorageLevel.MEMORY_AND_DISK)
        return self

    def unpersist(self) -> None:
        for df in reversed(self._tables):
            df.unpersist()

    def save(self, path: str, positions: bool = False) -> None:
        """Parquet, sorted within files by what look-ups go by, so that row groups and pages are skipped. Words and documents are shuffled twice, by word for the
        stem and by term; the other tables come from counts that are written first, so texts are read once (and once more for positions)."""
        spark = self.docs.sparkSession

        def put(name: str, rows: DataFrame) -> DataFrame:
            rows.write.mode("overwrite").parquet(f"{path}/{name}")
            return spark.read.parquet(f"{path}/{name}")

        docs = put("docs", self.docs.sortWithinPartitions("doc_idx"))
        if positions:
            # by document too, as a word may be in all of them
            put("positions", phrases.places(self.docs).repartition("word", "doc_idx").sortWithinPartitions("word"))
        if self.counts is not None:
            found = put("counts", self.counts)
            forms = put("forms", _forms(found, self.config).repartition("term").sortWithinPartitions("term"))
            rows = found.join(forms.select("word", "term"), "word")
        else:
            rows, found = self.staged, None
        staged = put("staged", _marked(rows) if "new" not in rows.columns else rows.repartition("term").sortWithinPartitions("term", "doc_idx"))
        source = of_staged(docs, staged, self.config, found)
        if self.counts is None:
            put("forms", source.forms.repartition("term").sortWithinPartitions("term"))
        terms = put("terms", source.terms.repartition("term").sortWithinPartitions("term"))
        lengths, limit = put("doc_stats", source.doc_stats), self.config.levenshtein_limit
        counts = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/counts")
        counts.getFileSystem(spark._jsc.hadoopConfiguration()).delete(counts, True)
        put("typos", T.entries(terms, limit).repartition("part").sortWithinPartitions("part"))
        row = lengths.agg(F.count("*").alias("n"), F.coalesce(F.sum("doc_len"), F.lit(0)).alias("total")).first()
        mean = row["total"] / row["n"] if row["n"] else 0.0
        put("corpus", small(spark, [(row["n"], mean, limit, positions)], "n bigint, mean double, typo_limit int, positions boolean"))

    @classmethod
    def load(cls, spark: SparkSession, path: str, config: EngineConfig | None = None) -> SearchIndex:
        """An index saved for another levenshtein_limit looks typos up in parts that it cuts anew."""
        read, config = (lambda name: spark.read.parquet(f"{path}/{name}")), config or EngineConfig()
        corpus = read("corpus").first()
        typos = read("typos") if corpus["typo_limit"] == config.levenshtein_limit else None
        return cls(read("docs"), postings(read("staged")), read("terms"), read("forms"), read("doc_stats"), config, (corpus["n"], corpus["mean"]), read("staged"), typos, positions=read("positions") if corpus["positions"] else None)

    def register(self, prefix: str = "") -> None:
        """Temporary views, for SQL over the index."""
        for name in ("docs", "postings", "terms", "forms", "doc_stats"):
            getattr(self, name).createOrReplaceTempView(prefix + name)


def _place(field: str, pos: str) -> Column:
    """A field and a position as one number, which aggregates by hashing can hold: structs would have all rows sorted."""
    return F.shiftleft(F.col(field).cast("long"), 32) + F.col(pos)


def _first() -> Column:
    """Where a term or form was first seen, of rows that are one for each document (for forms) or whose place is that of their document."""
    place = F.min_by("place", "doc_idx")
    return F.struct(F.min("doc_idx").alias("doc_idx"), F.shiftright(place, 32).cast("int").alias("field"), place.bitwiseAND((1 << 32) - 1).cast("int").alias("pos")).alias("first_pos")


def word_counts(docs: DataFrame) -> DataFrame:
    """A row for each word and document: counts by field and the first place. Documents are dealt first, as a table may be a single file."""
    counted = docs.select("doc_idx", "title", "keywords_text", "content").repartition("doc_idx").mapInArrow(split.counted, split.COUNTS)
    return counted.select("word", "doc_idx", *(F.col(name).alias(f"tf_{name}") for name in FIELDS), "place")


def vocabulary(docs: DataFrame, config: EngineConfig | None = None) -> DataFrame:
    """(term, word, first_pos): the forms of an index of docs, for what needs no more of it. Each batch of documents gives a word once, so no counts by document are kept."""
    found = docs.select("doc_idx", "title", "keywords_text", "content").repartition("doc_idx").mapInArrow(split.firsts, split.FIRSTS)
    return _forms(found, config or EngineConfig())


def build(docs: DataFrame, config: EngineConfig | None = None) -> SearchIndex:
    """Index of docs (schema.DOC). Lazy: nothing runs before a table is read."""
    config = config or EngineConfig()
    counts = word_counts(docs)
    forms = _forms(counts, config)
    built = of_staged(docs, counts.join(forms.select("word", "term"), "word"), config, doc_stats=lengths(docs))
    firsts = forms.groupBy("term").agg(F.min("first_pos").alias("first_pos"))
    return replace(built, forms=forms, counts=counts, typos=T.entries(firsts, config.levenshtein_limit))


def lengths(docs: DataFrame) -> DataFrame:
    """(doc_idx, doc_len): the indexed words of each body, from its text alone."""
    return docs.select("doc_idx", "content").mapInArrow(split.lengths, "doc_idx bigint, doc_len bigint")


def _marked(rows: DataFrame) -> DataFrame:
    """Counts with terms as they are saved: by term and document, new at the first row of a term in a document."""
    place = F.row_number().over(Window.partitionBy("term", "doc_idx").orderBy("place"))
    return rows.repartition("term").select("*", (place == 1).alias("new"))


def _forms(counts: DataFrame, config: EngineConfig) -> DataFrame:
    return X.with_stem(counts.groupBy("word").agg(_first()), "word", "term", config.lang).select("term", "word", "first_pos")


def postings(staged: DataFrame) -> DataFrame:
    return staged.groupBy("term", "doc_idx").agg(*(F.sum(f"tf_{name}").alias(f"tf_{name}") for name in FIELDS), F.min("place").alias("place"))


def _terms(postings: DataFrame) -> DataFrame:
    return postings.groupBy("term").agg(F.count("*").alias("df"), _first())


def of_staged(docs: DataFrame, staged: DataFrame, config: EngineConfig, counts: DataFrame | None = None, doc_stats: DataFrame | None = None) -> SearchIndex:
    """The tables of an index, from its counts by word and document with terms; lengths from counts, which have fewer columns, unless they are known."""
    summed = postings(staged)
    terms = _terms(staged.where("new") if "new" in staged.columns else summed)
    forms = staged.groupBy("term", "word").agg(_first())
    if doc_stats is None:
        found = (staged if counts is None else counts).groupBy("doc_idx").agg(F.sum("tf_body").alias("doc_len"))
        doc_stats = docs.select("doc_idx").join(found, "doc_idx", "left").select("doc_idx", F.coalesce("doc_len", F.lit(0)).alias("doc_len"))
    return SearchIndex(docs, summed, terms, forms, doc_stats, config, staged=staged, typos=T.entries(terms.select("term", "first_pos"), config.levenshtein_limit))
