"""Is a text about the incident? Case terms, identity scores, relevance, name clashes, keywords and search queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta.functions import fixed_values as fixed
from attesta.functions import text as X
from attesta.operators.ranking import top_k
from attesta.session import cut_lineage
from attesta.sources.tables import dimension

WORDS = r"[\p{L}\p{N}]+"


def _array(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")


def country_names(code: Column) -> Column:
    table = F.create_map(*[c for k, names, *_ in fixed.COUNTRIES for c in (F.lit(k), _array(names))])
    return F.coalesce(F.try_element_at(table, F.coalesce(code, F.lit(""))), F.array().cast("array<string>"))


def case_terms(cases: DataFrame) -> DataFrame:
    """(case_id, name, location, aliases, date_text) -> the word lists a text is compared with."""
    aliases = F.filter(F.split(F.coalesce("aliases", F.lit("")), ";"), lambda a: F.trim(a) != "")
    months = F.filter(_array(fixed.MONTHS), lambda m: F.contains(F.lower(F.coalesce("date_text", F.lit(""))), m))
    country = X.detect_country(F.col("location"))
    base = cases.select(
        "case_id", "name", "location", "aliases",
        X.sig_tokens(F.col("name")).alias("name_t"),
        F.transform(aliases, X.sig_tokens).alias("alias_t"),
        F.filter(X.sig_tokens(F.col("location")), lambda t: F.length(t) > 2).alias("loc_t"),
        F.array_sort(F.array_distinct(X.years_in(F.col("date_text")))).alias("years"),
        months.alias("months"), country.alias("country"))
    names = country_names(F.col("country"))
    return base.withColumn("country_names", names).withColumn(
        "native", F.array_except("country_names", "loc_t")).withColumn("compound", F.col("country").isNotNull())


def _hit(t: Column, toks: Column, low: Column, compound: Column) -> Column:
    """The word itself; for foreign places also compounds that start with it or, in other scripts, any occurrence."""
    ascii_word = t.rlike(r"^[\x00-\x7F]*$")
    longer = (F.length(t) >= 3) & F.exists(toks, lambda x: x.startswith(t) & (F.length(x) <= F.length(t) + 10))
    return F.array_contains(toks, t) | (compound & F.when(ascii_word, longer).otherwise(F.contains(low, t)))


def _share(words: Column, test, empty: float) -> Column:
    return F.when(F.size(words) > 0, F.size(F.filter(words, test)) / F.size(words)).otherwise(F.lit(empty))


def identity_score(texts: DataFrame, text: Column, published: Column | None = None, use_location: bool = True,
                   use_years: bool = True) -> DataFrame:
    """Adds identity_score and identity_why. ``texts`` already carries the case's terms (joined on case_id).

    Everything is computed inside the row with array functions; no words are exploded or shuffled.
    """
    cp = F.col("compound")
    target = F.col("years")
    stamp = F.coalesce(published, F.lit("")) if published is not None else F.lit("")
    first3 = lambda ys: F.array_join(F.slice(F.array_sort(F.array_distinct(ys)), 1, 3), ", ")
    stated = F.size(target) > 0 if use_years else F.lit(False)
    percent = lambda x: F.concat(F.bround(x * 100).cast("int"), F.lit("%"))

    # words and years are bound as lambda variables: a filter on the score, pushed below the projection, would put the columns'
    # own expressions at every place that names them and split the text again for every word of the case
    def read(low: Column) -> Column:
        return F.struct(low.alias("low"), F.array_distinct(F.regexp_extract_all(low, F.lit(WORDS), F.lit(0))).alias("toks"),
                        X.years_in(F.concat_ws(" ", low, stamp)).alias("seen"))

    def measure(x: Column) -> Column:
        hit = lambda t: _hit(t, x["toks"], x["low"], cp)
        alias_best = F.array_max(F.transform("alias_t", lambda a: _share(a, hit, 0.0)))
        in_place = lambda t: hit(t) | (F.array_contains(F.col("country_names"), t) & F.exists("native", hit))
        return F.struct(
            F.greatest(_share(F.col("name_t"), hit, 0.0), F.coalesce(alias_best, F.lit(0.0))).alias("name"),
            (_share(F.col("loc_t"), in_place, 0.5) if use_location else F.lit(0.5)).alias("loc"), x["seen"].alias("seen"),
            F.filter(x["seen"], lambda y: y < F.array_min(target)).alias("earlier"))

    def judge(x: Column) -> Column:
        seen, earlier = x["seen"], x["earlier"]
        only_earlier = stated & (F.size(earlier) > 0) & ~F.exists(seen, lambda y: y > F.array_max(target))
        year = (F.when(stated & F.arrays_overlap(seen, target), 1.0).when(only_earlier, 0.0)
                .when(stated & (F.size(seen) > 0), 0.35).otherwise(0.5))
        why = (F.when(stated & F.arrays_overlap(seen, target), "target year mentioned")
               .when(only_earlier, F.concat(F.lit("only earlier years mentioned ("), first3(earlier), F.lit(")")))
               .when(stated & (F.size(seen) > 0), F.concat(F.lit("other years mentioned ("), first3(seen), F.lit(")")))
               .otherwise("no year stated"))
        return F.struct(
            F.round(0.5 * x["name"] + 0.3 * x["loc"] + 0.2 * year, 3).alias("score"),
            F.concat(F.lit("name "), percent(x["name"]), F.lit(", location "), percent(x["loc"]), F.lit(", "), why).alias("why"))

    bound = F.array(F.lower(F.coalesce(text, F.lit(""))))
    for step in (read, measure, judge):
        bound = F.transform(bound, step)
    df = texts.withColumn("_verdict", F.get(bound, 0))
    return df.withColumns({"identity_score": F.col("_verdict.score"), "identity_why": F.col("_verdict.why")}).drop("_verdict")


TERM_COLUMNS = ["name_t", "alias_t", "loc_t", "years", "country_names", "native", "compound"]


def with_terms(df: DataFrame, terms: DataFrame) -> DataFrame:
    return df.join(terms.select("case_id", *TERM_COLUMNS), "case_id")


def relevance_status(sources: DataFrame, terms: DataFrame, head_chars: int = fixed.RELEVANCE_HEAD_CHARS) -> DataFrame:
    """Better of the head's and the whole text's score -> relevant, uncertain or irrelevant."""
    df = with_terms(sources, terms)
    head = identity_score(df, F.substring("text", 1, head_chars)).withColumnRenamed("identity_score", "head").withColumnRenamed(
        "identity_why", "head_why")
    both = identity_score(head, F.col("text"))
    score = F.greatest("head", "identity_score")
    return both.select(
        "case_id", "source_id", score.alias("relevance_score"),
        F.when(score >= 0.6, "relevant").when(score >= 0.4, "uncertain").otherwise("irrelevant").alias("relevance_status"),
        F.when(F.col("head") >= F.col("identity_score"), F.col("head_why")).otherwise(F.col("identity_why")).alias("relevance_reason"))


def identity_candidates(hits: DataFrame, terms: DataFrame, most_years: int = fixed.CANDIDATE_YEARS, years_per_hit: int = fixed.YEARS_PER_HIT,
                        most_examples: int = fixed.CANDIDATE_EXAMPLES) -> DataFrame:
    """Years under which the incident's name turns up, most frequent first, and whether the name is ambiguous."""
    text = F.concat_ws(" ", "title", "snippet")
    named = identity_score(with_terms(hits, terms), text, use_location=False, use_years=False).where("identity_score >= 0.45")
    years = F.slice(F.array_sort(F.array_distinct(X.years_in(F.concat_ws(" ", text, "published")))), 1, years_per_hit)
    by_year = cut_lineage(named.select("case_id", "hit_id", "title", F.explode(  # read by counts and examples
        F.when(F.size(years) > 0, years).otherwise(F.array(F.lit("(no year)")))).alias("year")))
    counts = by_year.groupBy("case_id", "year").agg(F.count("*").alias("n"), F.min("hit_id").alias("first_hit"))
    best = top_k(counts, ["case_id"], [F.desc("n"), F.asc("first_hit")], most_years).where("n >= 2")
    examples = top_k(by_year, ["case_id", "year"], [F.asc("hit_id")], most_examples, "nth").groupBy("case_id", "year").agg(
        F.array_sort(F.collect_list(F.struct("nth", "title"))).alias("e")).select(
        "case_id", "year", F.array_join(F.transform("e", lambda x: x["title"]), " | ").alias("examples"))
    rows = cut_lineage(best).join(terms.select("case_id", "years"), "case_id").withColumn(
        "on_target", F.array_contains("years", F.col("year"))).withColumn("dated", F.col("year") != "(no year)")
    verdict = rows.groupBy("case_id").agg(
        F.count_if("dated").alias("dated_n"), F.max(F.when(F.col("on_target"), F.col("n"))).alias("target_n"),
        F.max(F.when(F.col("dated") & ~F.col("on_target"), F.col("n"))).alias("other_n"), F.first("years").alias("target"))
    ambiguous = ((F.size("target") == 0) & (F.col("dated_n") >= 2)) | (
        (F.size("target") > 0) & F.coalesce(F.col("other_n") > 1.5 * F.coalesce("target_n", F.lit(0)), F.lit(False)))
    return rows.join(examples, ["case_id", "year"]).join(verdict.select("case_id", ambiguous.alias("ambiguous")), "case_id").select(
        "case_id", "rank", "year", "n", "examples", "ambiguous")


# ------------------------------------------------------------------------------------------------ keywords
def _upper_first(c: Column) -> Column:
    return F.substring(c, 1, 1).rlike(r"^\p{Lu}")


def _runs(words: Column, n: int) -> Column:
    """Runs of n capitalised words that neither start nor end with a stop word."""
    starts = F.when(F.size(words) >= n, F.sequence(F.lit(1), F.size(words) - (n - 1))).otherwise(F.array().cast("array<int>"))
    runs = F.transform(starts, lambda i: F.slice(words, i, F.lit(n)))
    plain = lambda w: ~F.lower(w).isin(fixed.KEYWORD_STOP_WORDS)
    good = F.filter(runs, lambda r: F.forall(r, _upper_first) & plain(F.get(r, 0)) & plain(F.get(r, n - 1)))
    return F.transform(good, lambda r: F.array_join(r, " "))


def deciding_candidates(top: int) -> int:
    """How many candidates always decide the first ``top``: those kept, at most three words of each kept phrase, and the
    pairs and triples of kept words (a phrase may repeat a word)."""
    return top + 3 * top + top**2 + top**3


def keyword_discovery(hits: DataFrame, terms: DataFrame, min_sites: int = 2, top: int = 8) -> DataFrame:
    """(case_id, rank, term, sites, anchored): terms that several websites use when they match the incident.

    ``hits`` carries hit_id, url, title, snippet, identity_score. Sites are counted from distinct (term, site) rows.
    """
    strong = hits.where("identity_score >= 0.5").select(
        "case_id", "hit_id", F.lower(X.url_domain(F.col("url"))).alias("host"),
        F.regexp_extract_all(F.concat_ws(" ", "title", "snippet"), F.lit(r"\p{L}[\p{L}\p{N}]+(?:-\p{L}[\p{L}\p{N}]+)*"), F.lit(0)).alias("w"))
    tokens = F.array_distinct(F.concat(F.filter("w", lambda w: F.length(w) >= 3), _runs(F.col("w"), 2), _runs(F.col("w"), 3)))
    # one row per spelling and site after an aggregation of numbers; the shown spelling is chosen among these few
    spelled = strong.select("case_id", "hit_id", "host", F.explode(tokens).alias("tok")).groupBy("case_id", "host", "tok").agg(
        F.min("hit_id").alias("first_hit")).withColumn("low", F.lower("tok"))
    seen = spelled.where(~F.col("low").isin(fixed.KEYWORD_STOP_WORDS) & ~F.col("low").rlike(r"^\d+$"))
    shown = F.max(F.struct(_upper_first(F.col("tok")).alias("up"), (-F.col("first_hit")).alias("o"), "tok")).alias("shown")
    per_site = seen.groupBy("case_id", "low", "host").agg(shown)
    found = per_site.groupBy("case_id", "low").agg(F.count("*").alias("sites"), F.max("shown").alias("s")).where(
        F.col("sites") >= min_sites).select("case_id", "low", "sites", F.col("s.tok").alias("term"))
    t = terms.select("case_id", F.concat("name_t", "loc_t").alias("own"), F.concat("name_t", "loc_t", F.flatten("alias_t")).alias("known"))
    anchored = F.exists("own", lambda a: (F.length(a) >= 3) & F.col("low").startswith(a) & (F.length("low") > F.length(a)))
    proper = _upper_first(F.col("term")) | ~F.col("term").rlike(r"^[\x00-\x7F]*$")
    rated = found.join(t, "case_id").where(~F.array_contains("known", F.col("low"))).withColumn("anchored", anchored).where(
        F.col("anchored") | proper).drop("own", "known").withColumn("words", F.size(F.split("term", " ")))
    order = [F.desc("anchored"), F.desc("sites"), F.desc("words"), F.asc("low")]
    first = top_k(rated, ["case_id"], order, deciding_candidates(top), "place")
    # whole rows are gathered, so nothing is joined back and the texts are read once
    rows = F.array_sort(F.collect_list(F.struct("place", "low", "term", "sites", "anchored")))
    listed = first.groupBy("case_id").agg(rows.alias("l"))
    kept = F.aggregate(F.transform("l", lambda x: x["low"]), F.array().cast("array<string>"), lambda k, low: _keep(k, low, top))
    named = listed.withColumn("kept", kept).select("case_id", F.posexplode(F.filter("l", lambda x: F.array_contains(F.col("kept"), x["low"]))).alias("pos", "x"))
    return named.select("case_id", (F.col("pos") + 1).alias("rank"), "x.term", "x.sites", "x.anchored")


def _keep(kept: Column, low: Column, top: int) -> Column:
    """Skip a word of a kept phrase, a phrase whose words are all kept, and all that comes behind the first ``top``."""
    inside = F.exists(kept, lambda k: F.contains(k, F.lit(" ")) & F.array_contains(F.split(k, " "), low))
    covered = F.contains(low, F.lit(" ")) & F.forall(F.split(low, " "), lambda w: F.array_contains(kept, w))
    return F.when((F.size(kept) >= top) | inside | covered, kept).otherwise(F.concat(kept, F.array(low)))


def add_aliases(terms: DataFrame, keywords: DataFrame) -> DataFrame:
    """Anchored keywords (at most eight per case) become aliases of the incident."""
    auto = keywords.where("anchored").groupBy("case_id").agg(F.array_sort(F.collect_list(F.struct("rank", "term"))).alias("k")).select(
        "case_id", F.transform("k", lambda x: X.sig_tokens(x["term"])).alias("auto"))
    return terms.join(auto, "case_id", "left").withColumn(
        "alias_t", F.when(F.col("auto").isNotNull(), F.concat("alias_t", "auto")).otherwise(F.col("alias_t"))).drop("auto")


def score_hits(hits: DataFrame, terms: DataFrame) -> DataFrame:
    df = with_terms(hits.drop("identity_score", "identity_why"), terms)
    return identity_score(df, F.concat_ws(" ", "title", "snippet", "url"), F.col("published")).drop(*TERM_COLUMNS)


def expand_aliases(hits: DataFrame, terms: DataFrame) -> DataFrame:
    """Two rounds: discover keywords, let anchored ones count as aliases, score the hits again, discover once more.

    The few keywords of a round are checkpointed, so the hits are scored once per round.
    """
    found = None
    current = terms
    for _ in range(2):
        fresh = cut_lineage(keyword_discovery(score_hits(hits, current), current))
        if found is None:
            found = fresh
        else:
            fresh = fresh.join(found.select("case_id", F.lower("term").alias("known")),
                               [F.col("known") == F.lower("term"), fresh["case_id"] == found["case_id"]], "left_anti")
            merged = found.withColumn("round", F.lit(1)).unionByName(fresh.withColumn("round", F.lit(2)))
            order = [F.desc("anchored"), F.desc("sites"), F.asc("round"), F.asc("old_rank")]
            found = top_k(merged.withColumnRenamed("rank", "old_rank"), ["case_id"], order, 8).select(
                "case_id", "rank", "term", "sites", "anchored")
        current = add_aliases(terms, found)
    return found


# ------------------------------------------------------------------------------------------------ search queries
def core_query(terms: DataFrame) -> DataFrame:
    """Adds core: the incident name (an exact phrase when short), its place and its first year."""
    name = F.when(F.size("name_t") <= 3, F.concat(F.lit('"'), "name", F.lit('"'))).otherwise(F.col("name"))
    return terms.withColumn("core", F.trim(F.concat_ws(" ", name, "location", F.get("years", 0))))


def query_templates(terms: DataFrame, pages: int = 2) -> DataFrame:
    """(case_id, purpose, query, page) from the fixed templates."""
    rows = F.inline(F.array(*[F.struct(F.lit(p).alias("purpose"), F.lit(q).alias("template")) for p, q in fixed.QUERY_TEMPLATES]))
    df = core_query(terms).select("case_id", "core", rows)
    return df.select("case_id", "purpose", F.replace("template", F.lit("{core}"), F.col("core")).alias("query"),
                     F.explode(F.sequence(F.lit(1), F.lit(pages))).alias("page"))


def place_facts(terms: DataFrame) -> DataFrame:
    """Adds language, official domain, warning systems, place words, hazard and the local words of each case.

    The word tables have a fixed size and are broadcast; as literals they would outgrow one generated method.
    """
    spark = terms.sparkSession
    countries = dimension(spark, [
        (c, lang, site, " OR ".join(f'"{s}"' if " " in s else s for s in systems[:3])) for c, _, lang, site, systems in fixed.COUNTRIES
    ], "country string, lang string, site string, systems string")
    words = dimension(spark, fixed.LANGUAGE_WORDS, "lang string, disaster string, warning string, report string, inquiry string")
    hazards = dimension(spark, fixed.LANGUAGE_HAZARDS, "lang string, hazard string, local_word string")
    place = X.place_words(F.col("location"), F.col("country"))
    df = terms.withColumn("place", place).withColumn("place", F.when(F.col("place") == "", F.col("name")).otherwise(F.col("place"))).withColumn(
        "yr", F.coalesce(F.concat(F.lit(" "), F.get("years", 0)), F.lit(""))).withColumn(
        "hazard", F.coalesce(X.hazard_of(F.col("name")), X.hazard_of(F.col("location"))))
    return df.join(countries, "country", "left").join(words, "lang", "left").join(hazards, ["lang", "hazard"], "left").withColumn(
        "local_hazard", F.coalesce("local_word", "disaster")).drop("local_word", "disaster")


def localized_queries(terms: DataFrame) -> DataFrame:
    """(case_id, ord, purpose, query) for incidents outside the U.S."""
    c = F.col
    place = F.concat("place", "yr")
    local = lambda purpose, *words: F.when(c("warning").isNotNull(), F.struct(
        F.lit(purpose).alias("purpose"), F.concat_ws(" ", "local_hazard", place, *words).alias("query")))
    site = F.concat(F.lit("site:"), "site")
    rows = F.array(
        F.struct(F.lit("local: official reports").alias("purpose"),
                 F.concat_ws(" ", place, F.coalesce("hazard", F.lit("disaster")), F.lit("report"), site).alias("query")),
        F.struct(F.lit("local: warning systems").alias("purpose"),
                 F.concat_ws(" ", place, F.when(c("systems") != "", c("systems")).otherwise("public warning")).alias("query")),
        local("local language: warning", c("warning")),
        local("local language: inquiry / report", c("inquiry"), c("report")),
        local("local language: official", c("warning"), site),
        local("local language: report (PDF)", c("report"), F.lit("filetype:pdf")),
    )
    df = place_facts(terms).where("country IS NOT NULL").select("case_id", F.posexplode(rows).alias("pos", "q")).where("q IS NOT NULL")
    return df.select("case_id", (c("pos") + 1).alias("ord"), "q.purpose", "q.query")


def discovery_queries(keywords: DataFrame, terms: DataFrame, limit: int = 6) -> DataFrame:
    """(case_id, ord, purpose, query): each keyword with a warning word, and the best anchored one with a report word."""
    keywords = cut_lineage(keywords)  # few rows, read twice
    facts = place_facts(terms).select(
        "case_id", "yr", F.coalesce("warning", F.lit("warning")).alias("warn"), F.coalesce("report", F.lit("after-action report")).alias("rep"))
    plain = keywords.where(F.col("rank") <= limit).join(facts, "case_id").select(
        "case_id", F.col("rank").alias("ord"), F.concat(F.lit("discovered keyword: "), "term").alias("purpose"),
        F.concat("term", "yr", F.lit(" "), "warn").alias("query"))
    first = keywords.where("anchored").groupBy("case_id").agg(F.min(F.struct("rank", "term")).alias("a"))
    report = first.join(facts, "case_id").select(
        "case_id", F.lit(limit + 1).alias("ord"), F.concat(F.lit("discovered keyword: "), "a.term", F.lit(" (report)")).alias("purpose"),
        F.concat("a.term", "yr", F.lit(" "), "rep").alias("query"))
    return plain.unionByName(report)


def follow_links(links: DataFrame, pages: DataFrame, terms: DataFrame, best: int = 4) -> DataFrame:
    """Links of relevant pages worth reading: they hint at a report and are official, on the same host, or a PDF."""
    df = links.join(pages.where("relevance_status = 'relevant'").select("page_id", "case_id", "final_url"), "page_id")
    host = X.url_host(F.col("url"))
    hint = F.concat_ws(" ", "url", "link_text").rlike("(?i)" + fixed.LINK_HINT_PATTERN)
    official = host.endswith(".gov") | host.endswith(".us") | host.endswith(".mil") | (host == X.url_host(F.col("final_url")))
    fit = df.where(hint & (official | F.lower("url").endswith(".pdf")))
    scored = identity_score(with_terms(fit, terms), F.concat_ws(" ", "link_text", "url"), use_years=False).withColumn(
        "score", F.greatest("identity_score", F.lit(0.35)))
    return top_k(scored, ["page_id"], [F.desc("score"), F.asc("ord")], best).select("page_id", "rank", "url", "score")
