"""Queries over the test tables, one or more for each operator."""

from __future__ import annotations

import tempfile
from collections.abc import Callable
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumensift.functions import text as X
from lumensift.functions.sql import register_functions
from lumensift.operators import catalog, facets, rag, typos
from lumensift.operators.highlight import fragments, with_fragments
from lumensift.operators.index import SearchIndex, build, occurrences, vocabulary
from lumensift.operators.search import LOOKED_AT, NEIGHBOURS, rounded, search, search_batch
from lumensift.operators.segments import GrowingIndex
from lumensift.operators.suggest import did_you_mean, merged_suggestions, suggest
from lumensift.plans.query import parsed_columns, parts_of
from lumensift.schema import EngineConfig, small
from lumensift.sources import corpora
from lumensift.sources.state import Store
from lumensift.streaming import learner, trending

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
_INDEXES: dict[tuple, SearchIndex] = {}

#: Characters that have full-width forms, and a query with every sign.
PLAIN = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
ASKED = '+%s -%s "%s" @%s #%s %s "" +'
FORMS = ("thing", "ingthe", "tion")
BATCH = ((1, "thing erble"), (2, "ering"), (3, "thing -ering"), (4, "nicht"), (5, "thing @en"), (6, "erble #src1 #src2"), (7, "+thing the"))


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def index_of(spark: SparkSession, sf_dir: str, corpus: Callable[[SparkSession, str], DataFrame]) -> SearchIndex:
    """An index is built once for a session and corpus, and kept."""
    key = (spark.sparkContext.applicationId, sf_dir, corpus.__name__)
    if key not in _INDEXES:
        _INDEXES[key] = build(corpus(spark, sf_dir)).persist()
    return _INDEXES[key]


def _documents(spark: SparkSession, sf_dir: str) -> SearchIndex:
    return index_of(spark, sf_dir, corpora.documents)


def _parts(spark: SparkSession, sf_dir: str) -> SearchIndex:
    return index_of(spark, sf_dir, corpora.parts)


def _growing(spark: SparkSession, sf_dir: str) -> GrowingIndex:
    """The documents, come in three portions by language; then those of one source were withdrawn."""
    growing, docs = GrowingIndex(spark, f"{_folder(spark)}/index"), corpora.documents(spark, sf_dir)
    for portion in (F.col("category") == "en", F.col("category").isin("de", "fr"), ~F.col("category").isin("en", "de", "fr")):
        growing.add(docs.where(portion))
    growing.delete(docs.where(F.array_contains("tags", "src1")).select("id"))
    return growing


def _grown(spark: SparkSession, sf_dir: str) -> SearchIndex:
    key = (spark.sparkContext.applicationId, sf_dir, "grown")
    if key not in _INDEXES:
        _INDEXES[key] = _growing(spark, sf_dir).view()
    return _INDEXES[key]


def _hits(index: SearchIndex, text: str, **options: object) -> DataFrame:
    return search(index, text, **options).hits.select("rank", "id", "score")


# --- Text and index ------------------------------------------------------------------------------------------------------


@query
def tokenize_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = X.normalised(corpora.documents(spark, sf_dir).select("doc_idx", "content"), "content").select("doc_idx", X.words_of(F.col("content")).alias("raw"))
    kept = words.select("doc_idx", "raw", F.filter("raw", lambda w: ~X.is_stop_word(w)).alias("kept"))
    return kept.select("doc_idx", F.size("raw").cast("bigint").alias("n_raw"), F.size("kept").cast("bigint").alias("n_words"), F.size(F.array_distinct("kept")).cast("bigint").alias("n_distinct"))


@query
def vocab_stem_en(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = occurrences(corpora.documents(spark, sf_dir)).select("word").distinct()
    return X.with_stem(words, "word", "stem")


@query
def stem_ru_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of the documents as the Russian layout gives them, which have all letters and many endings of Russian."""
    words = occurrences(corpora.documents(spark, sf_dir)).select("word").distinct()
    typed = words.select(X.layout_ru(F.col("word")).alias("word")).where("word is not null").distinct()
    return X.with_stem(typed, "word", "stem").select("word", "stem", X.detect_lang(F.col("word")).alias("lang"), X.has_cyrillic(F.col("word")).alias("cyrillic"))


@query
def nfkc_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents in full-width letters and digits, which normalisation makes plain again: the words come out as those of the plain texts."""
    wide = F.translate("content", PLAIN, "".join(chr(ord(c) + 0xFEE0) for c in PLAIN))
    words = corpora.documents(spark, sf_dir).select("doc_idx", X.raw_words(wide).alias("words"))
    return words.select("doc_idx", F.size("words").cast("bigint").alias("n_words"), F.md5(F.array_join("words", "|").cast("binary")).alias("digest"))


@query
def index_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(spark, sf_dir).postings.select("term", "doc_idx", "tf_title", "tf_keywords", "tf_body")


@query
def index_terms_df(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = _documents(spark, sf_dir)
    forms = index.forms.groupBy("term").agg(F.count("*").alias("n_forms"))
    return index.terms.join(forms, "term").select("term", "df", "n_forms", F.col("first_pos.doc_idx").alias("first_doc"))


@query
def index_doc_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(spark, sf_dir).doc_stats.select("doc_idx", "doc_len")


@query
def dictionary_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The terms of the small corpus in the order in which they were first seen."""
    terms = _parts(spark, sf_dir).terms
    return terms.select("term", F.col("first_pos.doc_idx").alias("doc_idx"), F.col("first_pos.field").cast("bigint").alias("field"), F.col("first_pos.pos").cast("bigint").alias("pos"))


@query
def corpus_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facets.statistics(_documents(spark, sf_dir))


@query
def segments_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms of an index that grew and shrank."""
    return _grown(spark, sf_dir).terms.select("term", "df", F.col("first_pos.doc_idx").alias("first_doc"))


@query
def segments_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hits(_grown(spark, sf_dir), "thing erble")


@query
def segments_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same after a merge into one segment, by document: lengths, and how many terms each has."""
    growing = _growing(spark, sf_dir)
    growing.merge()
    view = growing.view()
    return view.postings.groupBy("doc_idx").agg(F.count("*").alias("n_terms")).join(view.doc_stats, "doc_idx").select("doc_idx", "doc_len", "n_terms")


# --- Retrieval -------------------------------------------------------------------------------------------------------------


@query
def search_single_term(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hits(_documents(spark, sf_dir), "thing")


@query
def search_and_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hits(_documents(spark, sf_dir), "thing erble")


@query
def search_required_excluded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hits(_documents(spark, sf_dir), "+thing -ering")


@query
def search_phrase(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hits(_documents(spark, sf_dir), '"Apache License"')


@query
def search_phrase_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same on a saved index with the places of words, which say what documents are read."""
    key = (spark.sparkContext.applicationId, sf_dir, "saved")
    if key not in _INDEXES:
        path = f"{_folder(spark)}/index"
        build(corpora.documents(spark, sf_dir)).save(path, positions=True)
        _INDEXES[key] = SearchIndex.load(spark, path)
    return _hits(_INDEXES[key], '"Apache License"')


@query
def search_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hits(_documents(spark, sf_dir), "@EN thing")


@query
def search_tags_any(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hits(_documents(spark, sf_dir), "thing #src1 #SRC2")


@query
def search_filters_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hits(_documents(spark, sf_dir), "the @fr")


@query
def search_fuzzy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hits(_parts(spark, sf_dir), "wdget")


@query
def search_fuzzy_off(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hits(_parts(spark, sf_dir), "wdget", fuzzy=False)


@query
def search_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hits(_parts(spark, sf_dir), "цшвпуе")


@query
def search_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = _documents(spark, sf_dir)
    totals = [search(index, q).ranked.agg(F.lit(q).alias("query"), F.count("*").alias("total")) for q in ("thing", "thing erble", "thing -ering")]
    return totals[0].union(totals[1]).union(totals[2])


@query
def search_batch_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    queries = small(spark, BATCH, "query_id bigint, query string")
    return search_batch(_documents(spark, sf_dir), queries, limit=10).select("query_id", "rank", "id", "score")


@query
def parse_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries with every sign, made of the parts' names, types and brands."""
    rows = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("query_id"), F.format_string(ASKED, "p_brand", "p_type", "p_name", "p_type", "p_brand", "p_name").alias("query"))
    rows = rows.repartition("query_id").withColumn("parts", parts_of(F.col("query")))  # dealt, as the table may be a single file
    columns = parsed_columns(F.col("query"), F.col("parts"))
    joined = [F.array_join(columns[n], "|").alias(n) for n in ("required", "excluded", "words", "tags")]
    return rows.select("query_id", *joined, columns["phrase"].alias("phrase"), columns["category"].alias("category"))


@query
def parse_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").withColumn("parts", parts_of(F.col("text")))
    columns = parsed_columns(F.col("text"), F.col("parts"))
    return rows.select("conv_id", "turn", *(F.size(columns[n]).cast("bigint").alias(f"n_{n}") for n in ("required", "excluded", "words", "tags")))


@query
def sql_stem_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A query in SQL: how often each stem is said in the documents. Outer, as else Spark first filters by the size of what is exploded, and so finds all words twice; a null is no word below."""
    register_functions(spark)
    X.normalised(corpora.documents(spark, sf_dir).select("doc_idx", "content"), "content").createOrReplaceTempView("lumensift_texts")
    return spark.sql("""
        WITH said AS (SELECT word, count(*) AS n FROM (SELECT explode_outer(words) AS word FROM (SELECT lumen_words(content) AS words FROM lumensift_texts)) GROUP BY word)
        SELECT lumen_stem(word) AS term, sum(n) AS n FROM said WHERE NOT lumen_is_stop(word) GROUP BY ALL""")


@query
def sql_tokenize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table function over the documents: words of each text, those that are indexed, and different ones of these."""
    register_functions(spark)
    spark.read.parquet(f"{sf_dir}/documents.parquet").createOrReplaceTempView("lumensift_documents")
    return spark.sql("""
        SELECT id AS doc_id, count(*) AS n_raw, count_if(NOT stop) AS n_words, count(DISTINCT word) FILTER (WHERE NOT stop) AS n_distinct
        FROM lumen_tokenize(TABLE(lumensift_documents), 'doc_id', 'text') GROUP BY id""")


# --- Suggestions and presentation --------------------------------------------------------------------------------------------


@query
def suggest_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suggest(_documents(spark, sf_dir), "the thi")


@query
def suggest_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = learner.remember(spark.read.parquet(f"{sf_dir}/events.parquet"), "event_type")
    return merged_suggestions(_parts(spark, sf_dir), "p", learner.top(state, "p", 8), 8)


@query
def did_you_mean_hint(spark: SparkSession, sf_dir: str) -> DataFrame:
    result = search(_parts(spark, sf_dir), "wdget +wdget", fuzzy=False, limit=0)
    return spark.createDataFrame([("wdget +wdget", did_you_mean(result))], "query string, hint string")


@query
def highlight_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = with_fragments(search(_parts(spark, sf_dir), "economy", limit=10))
    return rows.select("rank", "id", F.array_join("fragments", "|").alias("fragments"))


@query
def highlight_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snippets of all documents around three forms, two of which overlap: ranges that unite, ranges apart, and no match."""
    cut = F.pandas_udf(lambda text: pd.Series(["|".join(fragments(t, list(FORMS))) for t in text], dtype=object), "string")
    return corpora.documents(spark, sf_dir).select("doc_idx", cut("content").alias("fragments"))


@query
def highlight_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = with_fragments(search(_documents(spark, sf_dir), "thing erble"))
    return rows.select("rank", "id", "title", F.array_join("fragments", "|").alias("fragments"))


# --- Facets, listing, catalogue ------------------------------------------------------------------------------------------------


@query
def facet_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facets.categories(corpora.documents(spark, sf_dir))


@query
def facet_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facets.tags(corpora.documents(spark, sf_dir))


@query
def context_facets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facets.both(corpora.parts(spark, sf_dir))


@query
def facet_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facets.cube(corpora.documents(spark, sf_dir)).select("category", "tag", "count")


@query
def list_documents_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facets.page(corpora.documents(spark, sf_dir), category="EN", tag="src1", limit=10, offset=5).select("doc_idx", "id", "title", "category")


@query
def providers_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The providers that each word of the conversations finds."""
    said = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(F.explode(X.raw_words(F.col("text"))).alias("query")).distinct()
    return catalog.matching(said).select("query", "id", "name", "group", F.array_join("models", ",").alias("models"))


@query
def bots_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bots named by the first word of each turn, registered turn after turn; the last turn with a word decides."""
    said = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    commands = F.array(F.lit(" /start"), F.concat(F.lit("/"), "role", F.lit(" ")), F.lit(""), F.lit("/start"), F.concat(F.lit("/turn"), "turn"))
    name = F.concat(F.lit(" "), F.substring_index("text", " ", 1), F.lit(" "))
    rows = said.select((F.col("conv_id") * 1_000_000 + F.col("turn")).alias("ord"), name.alias("name"), F.col("role").alias("platform"), commands.alias("commands"))
    return catalog.clean_bots(rows).select("name", "platform", F.array_join("commands", ",").alias("commands"))


# --- Learning and state ----------------------------------------------------------------------------------------------------------


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_type")


@query
def query_log_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return learner.remember(_events(spark, sf_dir), "event_type")


@query
def query_log_top_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return learner.top(query_log_counts(spark, sf_dir), " P", 3)


@query
def query_log_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same counts from a stream of two batches, kept in a store. Its last batch comes twice."""
    folder = _folder(spark)
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").option("maxFilesPerTrigger", 2).parquet(_watched(spark, sf_dir, folder))
    store = Store(spark, f"{folder}/state")
    learner.learn_stream(stream, store, f"{folder}/checkpoint", "event_type").awaitTermination()
    store.merge(store.load().select("query", (F.col("n") * 2).alias("n")), 1, f"{folder}/checkpoint")
    return store.load()


def _trending(spark: SparkSession, sf_dir: str, counted: Callable[[DataFrame], DataFrame]) -> DataFrame:
    folder = _folder(spark)
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    # every event comes twice
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(_watched(spark, sf_dir, folder))
    twice = stream.withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2))))
    trending.written(counted(trending.events(twice, "event_type", "ts", "event_id", "2 hours", "user_id")), f"{folder}/trending", f"{folder}/checkpoint")
    return spark.read.parquet(f"{folder}/trending")


@query
def trending_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sliding windows of an hour over the events, as far as they are final."""
    rows = _trending(spark, sf_dir, trending.windows)
    return rows.select(F.unix_micros("start").alias("start_us"), F.unix_micros("end").alias("end_us"), "query", "n")


@query
def trending_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of the users, with gaps of half an hour, as far as they are final."""
    rows = _trending(spark, sf_dir, lambda events: trending.sessions(events, "user_id"))
    return rows.select("user_id", F.unix_micros("start").alias("start_us"), F.unix_micros("end").alias("end_us"), "n")


@query
def state_backup_restore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts that went through a snapshot and back, after the state was emptied."""
    store = Store(spark, f"{_folder(spark)}/state")
    counts = query_log_counts(spark, sf_dir)
    store.save(counts)
    store.backup(store.load())
    store.save(counts.limit(0))
    store.restore()
    return learner.replaced(store.load())


@query
def dataset_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents written as a dataset and imported again."""
    path = f"{_folder(spark)}/dataset"
    corpora.write_dataset(corpora.documents(spark, sf_dir), path)
    rows = spark.read.schema(corpora.RAW).json(path).withColumn("doc_idx", F.col("id").cast("bigint"))
    return corpora.as_corpus(rows).select("doc_idx", "id", "title", F.char_length("content").cast("bigint").alias("n_chars"), "keywords_text", F.array_join("tags", "|").alias("tags"), "category", "link")


def _folder(spark: SparkSession) -> str:
    """A new folder that all executors reach: in the shared checkpoint folder, or a temporary one where none is set."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        return Path(tempfile.mkdtemp(prefix="lumensift")).as_uri()
    return f"{shared.rstrip('/')}/{spark.sparkContext._jvm.java.util.UUID.randomUUID()}"


def _watched(spark: SparkSession, sf_dir: str, folder: str) -> str:
    """A folder with the events, for a stream to read: streams read folders, and the table may be one file."""
    spark.read.parquet(f"{sf_dir}/events.parquet").repartition(4).write.parquet(f"{folder}/events")
    return f"{folder}/events"


# --- Retrieval contexts ------------------------------------------------------------------------------------------------------------


@query
def rag_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rag.context_text(rag.contexts(search(_documents(spark, sf_dir), "thing erble", limit=5)))


@query
def rag_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rag.contexts(search(_documents(spark, sf_dir), "thing erble", limit=5))
    return rows.select(F.col("rank").cast("string").alias("id"), "title", "link")


# --- Scalar functions ----------------------------------------------------------------------------------------------------------------


@query
def layout_fix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of the documents as the Russian layout gives them, and back."""
    words = occurrences(corpora.documents(spark, sf_dir)).select("word").distinct()
    return words.select("word", X.layout_ru(F.col("word")).alias("ru"), X.layout_en(X.layout_ru(F.col("word"))).alias("back"))


@query
def levenshtein_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of terms within distance 2."""
    terms = _parts(spark, sf_dir).terms.select("term", "first_pos")
    pairs = typos.within(typos.entries(terms, 2), typos.probes(terms.select(F.col("term").alias("word")), 2), 2)
    return pairs.where("word < term").select(F.col("word").alias("a"), F.col("term").alias("b"), F.col("dist").cast("bigint").alias("distance"))


@query
def spelling_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The neighbours of all words of the conversations whose stems the documents lack."""
    forms, limit = vocabulary(corpora.documents(spark, sf_dir)), EngineConfig().levenshtein_limit
    terms = forms.groupBy("term").agg(F.min("first_pos").alias("first_pos")).persist()
    said = X.normalised(spark.read.parquet(f"{sf_dir}/conversations.parquet").select("text"), "text").select(F.explode(X.words_of(F.col("text"))).alias("word")).distinct()
    stems = X.with_stem(said.where(~X.is_stop_word(F.col("word"))), "word", "stem").select(F.col("stem").alias("word")).distinct()
    lost = stems.join(terms.select(F.col("term").alias("word")), "word", "left_anti")
    return typos.nearest_of_many(terms, lost, limit, NEIGHBOURS, NEIGHBOURS * LOOKED_AT)


@query
def detect_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpora.documents(spark, sf_dir).groupBy(X.detect_lang(F.col("content")).alias("detected"), "category").agg(F.count("*").alias("n"))


@query
def mean_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All matches of a query, not only the first: their number and mean score."""
    rows = search(_documents(spark, sf_dir), "thing").ranked
    return rows.agg(F.count("*").alias("n"), rounded(F.avg("score"), 3).alias("mean_score"))
