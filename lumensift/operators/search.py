"""Retrieval: words to index terms, conjunctive BM25, filters, ranking.

All terms of a query must occur in a document. A word that the index lacks is tried on the other keyboard layout, and by edit
distance, whose nearest terms (three at most) must all occur as well. Words that nothing resolves are left out; a query without
any term left matches every document, with score 0.

search() plans one query; the few words of a query are resolved by one small job, the rest is one lazy plan.
search_batch() plans a table of queries at once.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from lumensift.functions import text as X
from lumensift.functions.stopwords import STOP_WORDS
from lumensift.operators import phrases, typos
from lumensift.operators.index import SearchIndex
from lumensift.plans.query import ParsedQuery, parse, parsed_columns
from lumensift.schema import small

#: Neighbours of a misspelt word that are taken, and how many times as many are looked at, in the order of the index.
NEIGHBOURS, LOOKED_AT = 3, 4
#: Different terms of a batch that are named to the scans; with more, all terms are joined.
NAMED = 1000


@dataclass(frozen=True)
class Resolved:
    """Index terms of a query in their order, and those that came from spelling (the others matched)."""

    terms: tuple[str, ...]
    matched: tuple[str, ...]
    fuzzy: tuple[str, ...]
    excluded: tuple[str, ...]


def nearest(index: SearchIndex, words: DataFrame, most: int, limit: int, few: bool = False) -> DataFrame:
    """(word, term, rank) of the dictionary terms within `limit` edits of words(word), but not equal: of the first 4 * most in index
    order the `most` nearest. Words meet terms through equal parts (see typos.py). few: the plan holds the words itself, and what they ask for prunes the scan."""
    entries = index.typos_within(limit)
    if few:
        found = words.select("word", typos.asked(F.col("word"), limit).alias("keys")).collect()  # the optimizer itself works this out; no job runs
        rows = [(r["word"], *key) for r in found for key in r["keys"]]
        asked = small(words.sparkSession, rows, "word string, size int, place int, part string")
        entries = entries.where(F.col("part").isin(*sorted({r[3] for r in rows})))
    else:
        asked = typos.probes(words.distinct(), limit)
    return typos.nearest(entries, asked, limit, most, most * LOOKED_AT)


def variants(words: DataFrame, lang: str) -> DataFrame:
    """(word, kind, stem) of words(word): of the word itself (kind stem), and of what the other keyboard layouts give (ru, en) unless it is a stop word."""
    kinds = F.array(*(F.struct(F.lit(kind).alias("kind"), F.when(good, text).alias("text")) for kind, text, good in _variants(F.col("word"))))
    return words.select("word", F.inline(kinds)).where("text is not null").select("word", "kind", X.stem(F.col("text"), lang).alias("stem"))


def _variants(word: Column) -> list[tuple[str, Column, Column]]:
    """Kind, text and whether it counts, of a word and of what the other keyboard layouts make of it."""
    layouts = [("ru", X.layout_ru(word)), ("en", X.layout_en(word))]
    return [("stem", word, F.lit(True)), *((kind, text, text.isNotNull() & ~X.is_stop_word(text)) for kind, text in layouts)]


def _stems(spark: SparkSession, index: SearchIndex, words: list[str], lang: str) -> dict[str, Row]:
    """For each lower-case word: its stem, those of its layout variants, and whether the index has them."""
    if not words:
        return {}
    rows = small(spark, [(w,) for w in dict.fromkeys(words)], "word string")
    word, found = F.col("word"), {w: {} for w in words}
    stems = [F.when(good, X.stem(text, lang)).alias(kind) for kind, text, good in _variants(word)]
    for r in rows.select("word", *stems).collect():  # the optimizer itself works this out; no job runs
        found[r["word"]] = {kind: r[kind] for kind in ("stem", "ru", "en") if r[kind] is not None}
    wanted = {s for kinds in found.values() for s in kinds.values()}
    known = {r["term"] for r in index.known().where(F.col("term").isin(*wanted)).collect()}
    return {w: Row(stem=k["stem"], exact=k["stem"] in known, layout=next((k[n] for n in ("ru", "en") if k.get(n) in known), None)) for w, k in found.items()}


def resolve(index: SearchIndex, parsed: ParsedQuery, lang: str = "auto", fuzzy: bool | None = None) -> Resolved:
    spark = index.terms.sparkSession
    fuzzy = index.config.fuzzy if fuzzy is None else fuzzy
    asked = [w for w in map(str.lower, [*parsed.required, *parsed.words]) if w not in STOP_WORDS]
    barred = [w for w in map(str.lower, parsed.excluded) if w not in STOP_WORDS]
    known = _stems(spark, index, asked + barred, lang)
    near: dict[str, list[str]] = {}
    lost = {known[w]["stem"] for w in asked if not known[w]["exact"]}
    if fuzzy and lost:
        rows = nearest(index, small(spark, [(w,) for w in sorted(lost)], "word string"), NEIGHBOURS, index.config.levenshtein_limit, few=True)
        for r in sorted(rows.collect(), key=lambda r: (r["word"], r["rank"])):
            near.setdefault(r["word"], []).append(r["term"])
    terms: dict[str, None] = {}
    matched: dict[str, None] = {}
    spelt: dict[str, None] = {}
    for w in asked:
        stem, exact, layout = known[w]["stem"], known[w]["exact"], known[w]["layout"]
        sure = stem if exact else layout
        if sure:
            terms[sure] = matched[sure] = None
        if not exact and stem not in terms:
            for term in near.get(stem, ()):
                terms[term] = spelt[term] = None
    excluded = tuple(known[w]["stem"] for w in barred if known[w]["exact"])
    return Resolved(tuple(terms), tuple(matched), tuple(spelt), excluded)


def bm25(index: SearchIndex) -> Column:
    """The score of a posting, over columns df, doc_len and the three counts."""
    c = index.config
    n, mean = index.corpus
    df, length = F.col("df").cast("double"), F.col("doc_len").cast("double")
    idf = F.log(F.lit(1.0) + (F.lit(float(n)) - df + 0.5) / (df + 0.5))
    norm = F.lit(c.k1) * (F.lit(1 - c.b) + (F.lit(c.b) * length) / F.lit(mean)) if mean else F.lit(float("nan"))
    score = F.lit(0.0)
    for name, weight in (("title", c.title_weight), ("keywords", c.keywords_weight), ("body", c.body_weight)):
        tf = F.col(f"tf_{name}").cast("double")
        score = score + F.when(tf > 0, F.lit(weight) * idf * ((tf * F.lit(c.k1 + 1)) / (tf + norm))).otherwise(0.0)
    return score


def few(terms: DataFrame) -> tuple[str, ...] | None:
    """The different terms of terms(term), if they are NAMED at most."""
    found = [r["term"] for r in terms.select("term").distinct().limit(NAMED + 1).collect()]
    return tuple(found) if len(found) <= NAMED else None


def scored_postings(index: SearchIndex, wanted: DataFrame, terms: tuple[str, ...] | None = None, batch: bool = False) -> DataFrame:
    """wanted(term, ...) joined to its postings, with score. `terms`, if the caller knows them, prune the scans of postings and terms;
    then wanted is as small as the query and is broadcast, unless it is that of a batch; else Spark decides by its size."""
    postings, known = (index.postings if terms is None else index.of_terms(terms)), index.terms.select("term", "df")
    if terms is not None:
        known = known.where(F.col("term").isin(*terms)) if index.counts is None else postings.groupBy("term").agg(F.count("*").alias("df"))
        wanted = wanted.join(F.broadcast(known), "term")
        wanted = wanted if batch else F.broadcast(wanted)
    else:
        wanted = known.join(wanted, "term")
    return postings.join(wanted, "term").join(index.doc_stats, "doc_idx").withColumn("score", bm25(index))


def total_in_order(order: str = "ord") -> Column:
    """Scores summed in the order of the terms, so that the result does not depend on the shuffle."""
    ordered = F.array_sort(F.collect_list(F.struct(order, "score")))
    return F.aggregate(ordered, F.lit(0.0), lambda a, x: a + x["score"])


def candidates(index: SearchIndex, resolved: Resolved) -> DataFrame:
    """(doc_idx, score) of documents that have all terms; of all documents, with score 0, if there are no terms."""
    spark = index.terms.sparkSession
    if resolved.terms:
        wanted = small(spark, [(t, i) for i, t in enumerate(resolved.terms)], "term string, ord int")
        rows = scored_postings(index, wanted, resolved.terms).groupBy("doc_idx").agg(F.count("*").alias("n"), total_in_order().alias("score"))
        found = rows.where(F.col("n") == len(resolved.terms)).select("doc_idx", "score")
    else:
        found = index.docs.select("doc_idx", F.lit(0.0).alias("score"))
    if resolved.excluded:
        barred = index.of_terms(resolved.excluded).select("doc_idx")
        found = found.join(barred, "doc_idx", "left_anti")
    return found


def passes(category: str | None, tags: list[str], phrase: str | None) -> Column:
    """Filters on documents: category, any of the tags, phrase as a substring of title and content; all without regard to case."""
    test = F.lit(True)
    if category:
        test = test & (F.lower(F.coalesce("category", F.lit(""))) == category.lower())
    if tags:
        test = test & F.coalesce(F.arrays_overlap(F.transform("tags", F.lower), F.array(*(F.lit(t.lower()) for t in tags))), F.lit(False))
    if phrase:
        hay = F.lower(F.concat(F.coalesce("title", F.lit("")), F.lit(" "), F.coalesce("content", F.lit(""))))
        test = test & F.contains(hay, F.lit(phrase.lower()))
    return test


def rounded(value: Column, digits: int) -> Column:
    """Halves go up."""
    return F.floor(value * 10**digits + 0.5) / 10**digits


@dataclass(frozen=True)
class SearchResult:
    """ranked: (doc_idx, score) of all matches, lazily. hits: the first `limit`, with the columns of a hit but for fragments."""

    index: SearchIndex
    query: str
    parsed: ParsedQuery
    resolved: Resolved
    ranked: DataFrame | None
    limit: int

    @cached_property
    def total(self) -> int:
        return 0 if self.ranked is None else self.ranked.count()

    @property
    def top(self) -> DataFrame:
        """(doc_idx, score) of the hits, score not rounded."""
        source = self.index.docs.select("doc_idx", F.lit(0.0).alias("score")).limit(0) if self.ranked is None else self.ranked
        return source.orderBy(F.desc("score"), "doc_idx").limit(self.limit)

    @cached_property
    def hits(self) -> DataFrame:
        best = self.top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "doc_idx")))  # at most `limit` rows
        rows = self.index.docs.join(F.broadcast(best), "doc_idx") if self.limit <= 10_000 else self.index.docs.join(best, "doc_idx")
        empty = F.array().cast("array<string>")
        text = [F.coalesce(c, F.lit("")).alias(c) for c in ("link", "category")]
        arrays = [F.coalesce(c, empty).alias(c) for c in ("tags", "keywords")]
        return rows.orderBy("rank").select("rank", "doc_idx", "id", "title", *text, *arrays, rounded(F.col("score"), 3).alias("score"), "content")


def search(index: SearchIndex, query: str | None, *, limit: int | None = None, category: str | None = None, tags: list[str] | None = None, fuzzy: bool | None = None, lang: str = "auto") -> SearchResult:
    """category and tags, if given (even if empty), replace those of the query."""
    query = (query or "").strip()
    limit = index.config.limit if limit is None else limit
    parsed = parse(query)
    if not query:
        return SearchResult(index, query, parsed, Resolved((), (), (), ()), None, limit)
    resolved = resolve(index, parsed, lang, fuzzy)
    found = candidates(index, resolved)
    category = parsed.category if category is None else category
    tags = parsed.tags if tags is None else tags
    if category or tags or parsed.phrase:
        docs = index.docs
        if parsed.phrase and index.positions is not None:
            docs = phrases.among(docs, phrases.candidates(index.positions, index.forms, parsed.phrase))
        found = found.join(docs.where(passes(category, tags, parsed.phrase)).select("doc_idx"), "doc_idx", "left_semi")
    return SearchResult(index, query, parsed, resolved, found, limit)


def resolve_batch(index: SearchIndex, queries: DataFrame, lang: str = "auto") -> DataFrame:
    """(query_id, term, ord) of the different terms of each query, ord being the place of the first. queries: query_id, query."""
    columns = parsed_columns(F.col("query"))
    asked = queries.select("query_id", F.posexplode(F.concat(columns["required"], columns["words"])).alias("place", "raw")).withColumn("word", F.lower("raw"))
    asked = asked.where(~X.is_stop_word(F.col("word")))
    known = index.known().select(F.col("term").alias("stem"), F.lit(True).alias("has"))
    kinds = variants(asked.select("word").distinct(), lang).join(known, "stem", "left")
    at = lambda kind, what: F.max(F.when(F.col("kind") == kind, what))
    stems = kinds.groupBy("word").agg(at("stem", F.col("stem")).alias("stem"), *(at(k, F.when(F.col("has"), F.col("stem"))).alias(f"has_{k}") for k in ("stem", "ru", "en")))
    near = nearest(index, stems.where("has_stem is null").select(F.col("stem").alias("word")), NEIGHBOURS, index.config.levenshtein_limit)
    sure = stems.select("word", F.coalesce("has_stem", "has_ru", "has_en").alias("term"), F.lit(0).alias("rank")).where("term is not null")
    spelt = stems.where("has_stem is null").select("word", "stem").join(near.withColumnRenamed("word", "stem"), "stem").select("word", "term", "rank")
    found = asked.join(sure.union(spelt), "word").groupBy("query_id", "term").agg(F.min(F.struct("place", "rank")).alias("ord"))
    return found


def _without_terms(docs: DataFrame, queries: DataFrame, limit: int) -> DataFrame:
    """(query_id, doc_idx, score) of documents for queries without any term, which mean every document. Documents come by the query's category, else by its tags; a
    query without filters needs the first `limit` alone; one that has a phrase or excluded words only is held against all."""
    key = lambda kind, value: F.struct(F.lit(kind).alias("kind"), value.alias("key"))
    bare = F.col("phrase").isNull() & (F.size("excluded") == 0)
    by_tag = F.transform(F.array_distinct("tags"), lambda t: key("tag", t))
    ways = F.when(F.coalesce("category", F.lit("")) != "", F.array(key("category", F.col("category")))).when(F.size("tags") > 0, by_tag)
    ways = ways.when(bare, F.array(key("first", F.lit("")))).otherwise(F.array(key("all", F.lit(""))))
    keys = F.concat(F.array(key("category", F.col("doc_category")), key("all", F.lit(""))), F.transform(F.array_distinct("doc_tags"), lambda t: key("tag", t)))
    places = docs.select("doc_idx", F.inline_outer(keys)).union(docs.orderBy("doc_idx").limit(limit).select("doc_idx", F.lit("first"), F.lit("")))
    # inline_outer, as inline has Spark filter by the whole of the expression first, far below
    met = places.join(queries.select("query_id", F.inline_outer(ways)), ["kind", "key"])
    return met.select("query_id", "doc_idx", F.lit(0.0).alias("score")).distinct()  # a document may have two of a query's tags


def search_batch(index: SearchIndex, queries: DataFrame, limit: int | None = None, lang: str = "auto") -> DataFrame:
    """(query_id, rank, doc_idx, id, score) for a table of queries(query_id, query), which Spark broadcasts if its size allows.

    Plain, required and excluded words, category, tags and phrase count. A query without any term gives its filtered documents in their order."""
    limit = index.config.limit if limit is None else limit
    terms = resolve_batch(index, queries, lang)
    wanted = terms.withColumn("n_terms", F.count("*").over(Window.partitionBy("query_id")))
    rows = scored_postings(index, wanted, few(terms), batch=True).groupBy("query_id", "doc_idx", "n_terms").agg(F.count("*").alias("n"), total_in_order().alias("score"))
    found = rows.where("n = n_terms").select("query_id", "doc_idx", "score")
    columns = parsed_columns(F.col("query"))
    parsed = queries.select("query_id", F.trim("query").alias("query"), *(c.alias(n) for n, c in columns.items())).where("query != ''")
    without = parsed.join(terms.select("query_id").distinct(), "query_id", "left_anti")
    docs = index.docs.select("doc_idx", "title", "content", F.lower(F.coalesce("category", F.lit(""))).alias("doc_category"), F.transform(F.coalesce("tags", F.array()), F.lower).alias("doc_tags"))
    found = found.union(_without_terms(docs, without, limit))
    barred = parsed.select("query_id", F.explode("excluded").alias("word")).select("query_id", F.lower("word").alias("word")).where(~X.is_stop_word(F.col("word")))
    barred = barred.select("query_id", X.stem(F.col("word"), lang).alias("term"))
    named = few(barred)
    barred = (index.postings if named is None else index.of_terms(named)).join(barred, "term").select("query_id", "doc_idx")
    found = found.join(barred, ["query_id", "doc_idx"], "left_anti")
    filters = parsed.select("query_id", "phrase", F.col("category").alias("wanted"), F.col("tags").alias("any_of"))
    hay = F.lower(F.concat("title", F.lit(" "), "content"))
    good = (F.coalesce("wanted", F.lit("")).isin("") | (F.col("wanted") == F.col("doc_category"))) & ((F.size("any_of") == 0) | F.arrays_overlap("doc_tags", "any_of")) & (F.coalesce("phrase", F.lit("")).isin("") | F.contains(hay, F.lower("phrase")))
    filtered = found.join(filters, "query_id")
    plain = filtered.where("wanted is null and size(any_of) = 0 and phrase is null").select("query_id", "doc_idx", "score")
    tested = filtered.where("not (wanted is null and size(any_of) = 0 and phrase is null)").join(docs, "doc_idx").where(good).select("query_id", "doc_idx", "score")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_idx"))
    best = plain.union(tested).withColumn("rank", rank).where(F.col("rank") <= limit)
    return best.join(index.docs.select("doc_idx", "id"), "doc_idx").select("query_id", "rank", "doc_idx", "id", rounded(F.col("score"), 3).alias("score"))
