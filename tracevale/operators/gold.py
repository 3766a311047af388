"""Runs judged against a gold set, whose parts are tables: expected requirements, links, absences, routes, goals and files."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import fold
from ..sources.store import scratch
from .evals import ratio
from .impact import viable
from .linking import contained_in_names

#: The fields of a gold set.
GOLD = (
    "requirements struct<must_extract:array<struct<id:string,source_uri:string,keywords:array<string>>>,expected_absent_in_crawl:array<struct<gold_id:string>>>, "
    "links struct<must_link:array<struct<element_name:string,route:string,symbol_file:string>>,must_not_link:array<struct<element_name:string,route:string,symbol_file:string>>>, "
    "impacts struct<required_affected_routes:array<string>,required_affected_flow_goal_keywords:array<array<string>>,required_unmapped_files:array<string>,min_findings:int>, "
    "thresholds map<string,double>"
)
TRIPLE = ["name", "route", "file"]


def read_gold(spark: SparkSession, path: str) -> DataFrame:
    """The gold set of one JSON file, as one row; a malformed file is an error."""
    return spark.read.schema(GOLD).option("multiLine", True).option("mode", "FAILFAST").json(path)


def expected(gold: DataFrame, part: str) -> DataFrame:
    """The rows of one of the gold set's lists, such as `links.must_link`."""
    items = gold.select(F.explode(part).alias("x"))
    return items.select("x.*") if items.schema["x"].dataType.typeName() == "struct" else items


def _written(df: DataFrame) -> DataFrame:
    """A table that is read several times, written once."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def _texts(requirements: DataFrame) -> DataFrame:
    """(uri, raw, id): the document of each requirement, and its statement and clues."""
    text = F.concat_ws(" ", F.coalesce("statement", F.lit("")), F.coalesce("acceptance_clues", F.array().cast("array<string>")))
    return requirements.select(F.coalesce("source_span.uri", F.lit("")).alias("uri"), text.alias("raw"), "id")


def _word_sets(wanted: DataFrame) -> DataFrame:
    """(gold_id, uri, words): folded keywords, each once; an unknown keyword stands nowhere, so its requirement isn't there."""
    g = wanted.select(F.col("id").alias("gold_id"), F.coalesce("source_uri", F.lit("")).alias("uri"), F.coalesce("keywords", F.array().cast("array<string>")).alias("keywords"))
    words = F.filter(F.array_sort(F.array_distinct(F.transform("keywords", fold))), lambda w: w != "")
    return _written(g.where(~F.exists("keywords", lambda w: w.isNull())).select("gold_id", "uri", words.alias("words")))


def _profiles(texts: DataFrame, sets: DataFrame) -> DataFrame:
    """(uri, raw, has), distinct: which of the words that its document is searched for each text has.

    Each text is folded and searched once, for all words together; texts and words that are equal count as one.
    """
    wanted = sets.select("uri", F.explode("words").alias("term")).distinct()
    t = texts.join(sets.select("uri").distinct(), "uri", "left_semi").select("uri", "raw").distinct()
    t = _written(t.withColumn("name", fold(F.col("raw"))))  # or else a condition on names would fold each text, copies too
    names, terms = t.select("name").distinct(), wanted.select("term").distinct()
    inside = contained_in_names(terms, names).unionByName(terms.join(names, F.col("term") == F.col("name")))
    held = t.select("uri", "name").distinct().join(inside, "name").join(wanted, ["uri", "term"], "left_semi").groupBy("uri", "name").agg(F.array_sort(F.collect_set("term")).alias("has"))
    return _written(t.join(held, ["uri", "name"], "left").select("uri", "raw", F.coalesce("has", F.array().cast("array<string>")).alias("has")))


def _met(sets: DataFrame, profiles: DataFrame, how: str) -> DataFrame:
    """Sets of words (uri, words) joined with the profiles (uri, has) that hold all of them; a set is looked up by its rarest word."""
    every = lambda words: F.explode(F.when(F.size(words) == 0, F.array(F.lit(""))).otherwise(F.col(words)))
    by_word = profiles.select("uri", "has").distinct().select("uri", "has", F.explode(F.array_append("has", F.lit(""))).alias("term"))
    often = by_word.groupBy("uri", "term").agg(F.count(F.lit(1)).alias("often"))
    each = sets.select("uri", "words").distinct().select("uri", "words", every("words").alias("term")).join(often, ["uri", "term"])
    rarest = each.groupBy("uri", "words").agg(F.min(F.struct("often", "term"))["term"].alias("term"))
    s, p = rarest.alias("s"), by_word.alias("p")
    on = (F.col("s.uri") == F.col("p.uri")) & (F.col("s.term") == F.col("p.term")) & (F.size(F.array_except("s.words", "p.has")) == 0)
    return s.join(p, on, how).select("s.uri", "s.words", *(["p.has"] if how == "inner" else []))


def requirement_matches(requirements: DataFrame, wanted: DataFrame) -> DataFrame:
    """(gold_id, id): requirements of a wanted one's document whose statement and clues hold all its keywords."""
    sets, texts = _word_sets(wanted), _texts(requirements)
    profiles = _profiles(texts, sets)
    return _met(sets, profiles, "inner").join(sets, ["uri", "words"]).join(profiles, ["uri", "has"]).join(texts, ["uri", "raw"]).select("gold_id", "id")


def requirement_recall(requirements: DataFrame, wanted: DataFrame) -> DataFrame:
    """(gold_id, recalled) of each wanted requirement; its matches aren't spelt out."""
    sets = _word_sets(wanted)
    met = _met(sets, _profiles(_texts(requirements), sets), "left_semi")
    hit = sets.join(met, ["uri", "words"], "left_semi").select("gold_id").distinct().withColumn("recalled", F.lit(True))
    return wanted.select(F.col("id").alias("gold_id")).join(hit, "gold_id", "left").select("gold_id", F.coalesce("recalled", F.lit(False)).alias("recalled"))


def share(rows: DataFrame, hit: str) -> DataFrame:
    """(n, hits, recall) of a table with a boolean; 1 where nothing was expected."""
    return rows.agg(F.count(F.lit(1)).alias("n"), F.count_if(hit).alias("hits")).withColumn("recall", ratio(F.col("hits"), F.col("n")))


def link_triples(links: DataFrame, elements: DataFrame, screens: DataFrame, symbols: DataFrame) -> DataFrame:
    """(name, route, file), distinct: viable links from an element, with its screen, to a symbol."""
    e = elements.select(F.col("id").alias("source_entity_id"), F.lower(F.coalesce("name", F.lit(""))).alias("name"), "screen_id")
    s = screens.select(F.col("id").alias("screen_id"), F.coalesce("route_pattern", F.lit("")).alias("route"))
    c = symbols.select(F.col("id").alias("target_entity_id"), F.coalesce("file", F.lit("")).alias("file"))
    return viable(links).join(e, "source_entity_id").join(c, "target_entity_id").join(s, "screen_id").select(*TRIPLE).distinct()


def gold_triples(wanted: DataFrame) -> DataFrame:
    null = F.lit("")
    return wanted.select(F.lower(F.coalesce("element_name", null)).alias("name"), F.coalesce("route", null).alias("route"), F.coalesce("symbol_file", null).alias("file"))


def link_verdicts(triples: DataFrame, must: DataFrame, must_not: DataFrame) -> DataFrame:
    """(name, route, file, verdict) of each gold link: matched or missed, violation or avoided."""
    there = triples.withColumn("there", F.lit(True))
    both = gold_triples(must).withColumn("wanted", F.lit(True)).unionByName(gold_triples(must_not).withColumn("wanted", F.lit(False)))
    j = both.join(there, TRIPLE, "left").withColumn("there", F.coalesce("there", F.lit(False)))
    verdict = F.when(F.col("wanted"), F.when(F.col("there"), "matched").otherwise("missed")).otherwise(F.when(F.col("there"), "violation").otherwise("avoided"))
    return j.select(*TRIPLE, verdict.alias("verdict"))


def affected(findings: DataFrame, elements: DataFrame, screens: DataFrame, flows: DataFrame) -> DataFrame:
    """(finding, kind, value), distinct: the routes that a finding affects, by a screen or by an element's screen, and its flows' goals."""
    ids = findings.select(F.col("id").alias("finding"), F.explode("affected_entity_ids").alias("entity"))
    s = screens.select(F.col("id").alias("screen_id"), F.coalesce("route_pattern", F.lit("")).alias("value"))
    direct = ids.join(s, F.col("entity") == F.col("screen_id")).select("finding", F.lit("route").alias("kind"), "value")
    e = elements.select(F.col("id").alias("entity"), "screen_id")
    by_element = ids.join(e, "entity").join(s, "screen_id").select("finding", F.lit("route").alias("kind"), "value")
    goals = ids.join(flows.select(F.col("id").alias("entity"), F.lower(F.coalesce("goal", F.lit(""))).alias("value")), "entity").select("finding", F.lit("goal").alias("kind"), "value")
    return reduce(DataFrame.unionByName, (direct, by_element, goals)).distinct()


def impact_checks(reached: DataFrame, unmapped: DataFrame, n_findings: Column | int, routes: DataFrame, keyword_groups: DataFrame, files: DataFrame, least: int) -> DataFrame:
    """(check, item, passed): wanted routes, goal keywords, unmapped files, and the number of findings."""

    def there(wanted: DataFrame, found: DataFrame, check: str) -> DataFrame:
        j = wanted.select(F.col("x").alias("item")).join(found.select(F.col("value").alias("item")).distinct().withColumn("hit", F.lit(True)), "item", "left")
        return j.select(F.lit(check).alias("check"), "item", F.coalesce("hit", F.lit(False)).alias("passed"))

    # a group is covered if one goal has all its words; a group without words by any goal
    goals = reached.where("kind = 'goal'").select(F.col("value").alias("name")).distinct()
    g = keyword_groups.select(F.array_distinct(F.transform("x", F.lower)).alias("w"), "x")
    g = g.select(F.array_join("x", ",").alias("item"), F.filter("w", lambda w: w != "").alias("w"))
    words = g.select(F.explode("w").alias("term")).distinct()
    inside = contained_in_names(words, goals).unionByName(words.join(goals, F.col("term") == F.col("name")))
    each = g.select("item", "w", F.size("w").alias("n"), F.explode("w").alias("term")).distinct().join(inside, "term")
    covered = each.groupBy("item", "w", "n", "name").agg(F.count(F.lit(1)).alias("found")).where("found = n").select("item", "w").distinct().withColumn("passed", F.lit(True))
    some = goals.limit(1).agg(F.count(F.lit(1)).alias("some"))  # one row
    groups = g.join(covered, ["item", "w"], "left").join(F.broadcast(some)).select(F.lit("goal").alias("check"), "item", F.coalesce("passed", (F.size("w") == 0) & (F.col("some") > 0)).alias("passed"))
    n = keyword_groups.sparkSession.range(1).select(F.lit("findings").alias("check"), F.lit(str(least)).alias("item"), (F.lit(n_findings) >= least).alias("passed"))
    return reduce(DataFrame.unionByName, (there(routes, reached.where("kind = 'route'"), "route"), groups, there(files, unmapped.select(F.col("file").alias("value")), "unmapped"), n))


def passed(checks: DataFrame) -> DataFrame:
    """(passed): whether all checks passed; no check fails nothing."""
    return checks.agg(F.coalesce(F.every("passed"), F.lit(True)).alias("passed"))


def absence_verdicts(absences: DataFrame, requirements: DataFrame, wanted: DataFrame, expected_absent: DataFrame) -> DataFrame:
    """(gold_id, found): whether a requirement that matches the expected one is among the absences."""
    absent = requirements.join(absences.select(F.col("requirement_id").alias("id")), "id", "left_semi")
    ids = requirement_recall(absent, wanted).where("recalled").select("gold_id", F.lit(True).alias("found")).distinct()
    return expected_absent.select("gold_id").join(ids, "gold_id", "left").select("gold_id", F.coalesce("found", F.lit(False)).alias("found"))


def run_signature(screens: DataFrame, elements: DataFrame, flows: DataFrame, triples: DataFrame, findings: DataFrame, symbols: DataFrame, reached: DataFrame) -> DataFrame:
    """(category, item): what a run found, in words that don't depend on the run."""
    route = screens.select(F.col("id").alias("screen_id"), F.col("route_pattern").alias("route"))
    pairs = elements.join(route, "screen_id").select(F.lit("elements").alias("category"), F.to_json(F.array("name", "route")).alias("item"))
    routes = reached.where("kind = 'route'").groupBy("finding").agg(F.array_sort(F.collect_set("value")).alias("routes"))
    files = symbols.select(F.col("id").alias("changed_symbol_id"), "file")
    f = findings.select(F.col("id").alias("finding"), "changed_symbol_id").join(files, "changed_symbol_id", "left").join(routes, "finding", "left")
    impacts = f.select(F.lit("impacts").alias("category"), F.to_json(F.struct(F.coalesce("file", "changed_symbol_id").alias("file"), F.coalesce("routes", F.array().cast("array<string>")).alias("routes"))).alias("item"))
    parts = (screens.select(F.lit("screens").alias("category"), F.col("route_pattern").alias("item")), pairs, flows.select(F.lit("flows").alias("category"), F.col("goal").alias("item")),
             triples.select(F.lit("links").alias("category"), F.to_json(F.array(*TRIPLE)).alias("item")), impacts)
    return reduce(DataFrame.unionByName, parts).distinct()


def unmapped_files(listed: DataFrame, records: DataFrame, changes: DataFrame) -> DataFrame:
    """(file), distinct and in order: files listed as unmapped, recorded as such, or changed without symbols."""
    bare = changes.where(F.size(F.coalesce("changed_symbol_ids", F.array().cast("array<string>"))) == 0)
    return reduce(DataFrame.unionByName, (x.select("file") for x in (listed, records, bare))).where("file is not null").distinct().orderBy("file")
