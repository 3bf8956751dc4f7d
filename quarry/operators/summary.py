"""Summaries: relevance, order, citations, excerpts, confidence, extractive and template texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.config import Lexicon
from quarry.functions import text as t


def is_relevant(title: Column, text: Column, keywords: Column, lexicon: Lexicon) -> Column:
    """P10: an alias or telling profile word in the text, or a keyword that holds or is held by a profile word."""
    low = F.lower(F.concat_ws(" ", title, text))
    direct = t.any_contained(low, [*lexicon.aliases, *(p for p in lexicon.profile if p not in lexicon.generic)])
    profile = t.literals(lexicon.profile)
    return direct | F.exists(F.coalesce(keywords, F.array().cast("array<string>")), lambda k: F.exists(profile, lambda p: F.contains(F.lower(k), p) | F.contains(p, F.lower(k))))


def relevance(title: Column, text: Column, keywords: Column, kind: Column, lexicon: Lexicon) -> Column:
    """Z2."""
    low = F.lower(F.concat_ws(" ", title, text))
    score = sum((F.when(t.any_contained(low, held), value).otherwise(0.0) for held, value in ((lexicon.aliases, 2.0), (lexicon.profile, 1.5), (lexicon.rivals, 1.2))), F.lit(0.0))
    factor = F.lit(1.0)
    for name, value in lexicon.type_weights:
        factor = F.when(kind == name, value).otherwise(factor)
    return F.when(is_relevant(title, text, keywords, lexicon), F.least(F.lit(1.0), score * factor / 10.0)).otherwise(0.0)


def prioritised(items: DataFrame, lexicon: Lexicon) -> DataFrame:
    """Relevant items by relevance and quality; where none is relevant, all by quality. Adds relevance and position."""
    rows = items.withColumn("relevance", relevance(F.col("title"), F.col("text"), F.col("keywords"), F.col("content_type"), lexicon))
    some = rows.agg(F.max(F.when(F.col("relevance") > 0, 1).otherwise(0)).alias("some"))  # one row
    kept = rows.crossJoin(F.broadcast(some)).where("some = 0 OR relevance > 0").drop("some")
    return kept.orderBy(F.col("relevance").desc(), F.col("quality_score").desc(), "id")


def overlap(summary: Column, text: Column) -> Column:
    return F.size(F.array_intersect(t.words(F.lower(summary)), t.words(F.lower(text))))


def citation_relevance(summary: Column, title: Column, text: Column, quality: Column) -> Column:
    """Share of the summary's distinct words in the item, times .5 to 1 by quality."""
    share = F.try_divide(overlap(summary, F.concat_ws(" ", title, text)), F.size(F.array_distinct(t.words(F.lower(summary)))))
    return F.least(F.lit(1.0), F.coalesce(share, F.lit(0.0)) * (quality * 0.5 + 0.5))


def excerpt(summary: Column, text: Column, most: int = 150) -> Column:
    """The first of the sentences of 20 characters or more that share most words with the summary; cut at `most`, else the text's beginning."""
    told = F.filter(t.sentences(text), lambda s: F.length(s) >= 20)
    scored = t.let(F.array_distinct(t.words(F.lower(summary))), lambda w: F.transform(told, lambda s, i: F.struct(F.size(F.array_intersect(w, F.split(F.lower(s), r"\s+"))).alias("n"), (-i).alias("p"), s.alias("s"))))
    best = F.array_max(F.filter(scored, lambda x: x["n"] > 0))["s"]
    short = F.when(F.length(best) > most, F.concat(F.substring(best, 1, most), F.lit("..."))).otherwise(best)
    return F.when(F.coalesce(text, F.lit("")) == "", "").otherwise(F.coalesce(short, F.concat(F.substring(text, 1, most), F.lit("..."))))


def citations(items: DataFrame, summary: Column, most: int | None = None) -> DataFrame:
    """Id, title, source, relevance, excerpt of every item; with `most` of the most relevant ones alone, for which excerpts are then made."""
    rel = citation_relevance(summary, F.col("title"), F.col("text"), F.col("quality_score"))
    scored = items.select("id", "title", "source", "text", F.round(rel, 6).alias("relevance"))
    if most is not None:
        scored = scored.orderBy(F.col("relevance").desc(), "id").limit(most)
    return scored.select("id", "title", "source", "relevance", excerpt(summary, F.col("text")).alias("excerpt"))


def confidence(cited: DataFrame, summary: Column) -> DataFrame:
    """Cited: quality_score, relevance."""
    n = F.size(t.words(summary))
    length = F.when(n < 10, 0.3).when(n < 50, 0.8).when(n < 200, 1.0).otherwise(0.9)
    score = F.least(F.lit(1.0), F.count("*") / 5.0) * 0.3 + F.coalesce(F.avg("quality_score"), F.lit(0.0)) * 0.3 + F.coalesce(F.avg("relevance"), F.lit(0.0)) * 0.2 + length * 0.2
    return cited.agg(F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)), 6).alias("confidence"))


def cut(text: Column, most: int) -> Column:
    """The first `most` words, with an ellipsis where there are more."""
    parts = t.words(text)
    return F.when(F.size(parts) > most, F.concat(F.array_join(F.slice(parts, 1, most), " "), F.lit("..."))).otherwise(text)


def extractive(items: DataFrame, most_words: int, by: str | None = None, first: int = 3) -> DataFrame:
    """Of the `first` items by quality, title and first sentence (if longer than 20 characters), cut to most_words. One row, or one for each value of `by`."""
    sentence = F.element_at(t.sentences(F.col("text")), 1)
    part = F.concat_ws(" ", "title", F.when(F.length(sentence) > 20, F.concat(sentence, F.lit("."))))
    w = Window.orderBy(F.col("quality_score").desc(), "id")
    if by:
        top = items.withColumn("r", F.row_number().over(w.partitionBy(by))).where(F.col("r") <= first)
    else:
        top = items.orderBy(F.col("quality_score").desc(), "id").limit(first).withColumn("r", F.row_number().over(w))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", part.alias("part")))), lambda x: x["part"]), " ")
    text = F.when(F.count("*") == 0, "No content available for summarization.").otherwise(cut(joined, most_words))
    return (top.groupBy(by) if by else top).agg(text.alias("summary"))


def template(items: DataFrame, kind: str = "brief", titles: int = 3) -> DataFrame:
    """Counts of items and sources, and the first titles by quality."""
    top = items.orderBy(F.col("quality_score").desc(), "id").limit(titles).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("quality_score")).alias("q"), "id", "title"))), lambda x: x["title"]), "; ").alias("titles"))
    n = items.agg(F.count("*").alias("n"), F.countDistinct("source").alias("sources"))
    text = {"brief": "%d items from %d sources: %s", "detailed": "Overview of %d items out of %d sources. Main items: %s"}.get(kind, "%d items, %d sources: %s")
    return n.crossJoin(F.broadcast(top)).select(F.format_string(text, "n", "sources", "titles").alias("summary"))


def prompt(items: DataFrame, focus: str = "", most: int = 2000, at_most: int = 20) -> DataFrame:
    """Z3: the blocks of the `at_most` best items in order of quality, texts cut to `most` characters: one summary is of a short list."""
    block = F.concat(F.lit("Title: "), F.col("title"), F.lit("\nSource: "), F.coalesce("source", F.lit("Unknown")), F.lit("\n"), F.substring(F.coalesce("text", F.lit("")), 1, most))
    best = items.orderBy(F.col("quality_score").desc(), "id").limit(at_most)
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("quality_score")).alias("q"), "id", block.alias("b"))))
    return best.agg(F.concat(F.lit(f"Focus: {focus}\n\n" if focus else ""), F.array_join(F.transform(ordered, lambda x: x["b"]), "\n---\n")).alias("prompt"))


def completed(prompts: DataFrame, complete, most_words: int = 200) -> DataFrame:
    """Prompts: id, prompt. complete(text) -> text runs on the executors; a failure gives a null summary and its error."""

    def run(batches):
        for pdf in batches:
            out = []
            for i, p in zip(pdf["id"], pdf["prompt"], strict=True):
                try:
                    parts = complete(p).split()
                    out.append((i, " ".join(parts[:most_words]) + ("..." if len(parts) > most_words else ""), None))
                except Exception as e:  # the service's own errors
                    out.append((i, None, str(e)))
            yield pdf[["id"]].assign(summary=[x[1] for x in out], error=[x[2] for x in out])

    return prompts.select("id", "prompt").mapInPandas(run, "id long, summary string, error string")
