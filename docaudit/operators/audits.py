"""Audits of documents. Each gives findings (one row per failure) and a one-row gate result.

An audit that had nothing to check is skipped and passes.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docaudit.functions import patterns as P
from docaudit.functions.dates import WRITTEN, YMD, with_date
from docaudit.functions.text import log_verdict
from docaudit.operators.claims import mentions


def gate_result(
    gate_type: str,
    required: bool,
    checked: DataFrame,
    n_checked: Column,
    n_failed: Column,
    skipped: Column | None = None,
    failed: Column | None = None,
) -> DataFrame:
    """The one-row result of a gate from an aggregate over what it checked."""
    row = checked.agg(
        F.coalesce(n_checked, F.lit(0)).cast("long").alias("n_checked"),
        F.coalesce(n_failed, F.lit(0)).cast("long").alias("n_failed"),
        (F.coalesce(skipped, F.lit(False)) if skipped is not None else F.lit(None)).alias("_skipped"),
        (F.coalesce(failed, F.lit(False)) if failed is not None else F.lit(False)).alias("_failed"),
    )
    idle = F.coalesce(F.col("_skipped"), F.col("n_checked") == 0)
    bad = ~idle & (F.col("_failed") | (F.col("n_failed") > 0))
    return row.select(
        F.lit(gate_type).alias("gate_type"),
        F.lit(required).alias("required"),
        (~bad).alias("passed"),
        idle.alias("skipped"),
        "n_checked",
        "n_failed",
        F.when(idle, "nothing to check")
        .otherwise(F.format_string("%d checked, %d failed", "n_checked", "n_failed"))
        .alias("details"),
    )


# Citations ----------------------------------------------------------------------------------------------------


def citations(docs: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """Every citation of an article or a section, over the whole text."""
    t = F.col(text)
    return docs.select(
        F.col(path).alias("path"),
        F.explode(F.concat(mentions(t, P.CITATION_ARTICLE, 0), mentions(t, P.CITATION_SECTION, 0))).alias("ref"),
    )


def citation_index(sources: DataFrame, text: str = "text", by: list[str] | None = None) -> DataFrame:
    """Distinct lower-cased references that occur inside source texts, as substrings; per ``by`` if given.

    A section number also contains its shorter forms: a source with ``section 1.10`` contains
    ``section 1.1``, so every cut after a digit that leaves a dotted number is in the index.
    """
    by = by or []
    token = sources.select(*by, F.explode(mentions(F.lower(F.col(text)), P.SOURCE_CITATION, 0)).alias("token"))
    shortest = rf"(?U)^section{P.SPACE}+\d++\.\d"
    cuts = F.transform(
        F.sequence(
            F.length(F.regexp_extract("token", shortest, 0)), F.greatest(F.length("token"), F.lit(1))
        ),
        lambda n: F.left(F.col("token"), n),
    )
    forms = F.when(
        F.startswith(F.col("token"), F.lit("section")), F.filter(cuts, lambda c: F.rlike(c, F.lit(r"(?U)\d\z")))
    ).otherwise(F.array("token"))
    return token.distinct().select(*by, F.explode(forms).alias("ref_key")).distinct()


def citation_findings(docs: DataFrame, sources: DataFrame, path: str = "path") -> DataFrame:
    """Per document and citation text: occurrences, and whether some source contains it.

    Occurrences are added up before the lookup, so a citation that fills a third of all documents reaches the
    join once per document at most.
    """
    counted = citations(docs, path).groupBy("path", "ref").agg(F.count(F.lit(1)).alias("n"))
    known = citation_index(sources).withColumn("found", F.lit(True))
    return (
        counted.withColumn("ref_key", F.lower("ref"))
        .join(known, "ref_key", "left")
        .select("path", "ref", "n", F.coalesce("found", F.lit(False)).alias("found"))
    )


def citation_audit(findings: DataFrame, sources: DataFrame, required: bool = False) -> DataFrame:
    """Skipped without a citation, and without a source to look them up in."""
    n, missing = F.sum("n"), F.sum(F.when(~F.col("found"), F.col("n")))
    there = sources.agg(F.count(F.lit(1)) > 0).scalar()
    idle = F.coalesce(n, F.lit(0)) == 0
    return gate_result("citation_audit", required, findings.withColumn("_there", there), n, missing, skipped=idle | ~F.first("_there"))


# URLs ---------------------------------------------------------------------------------------------------------


def url_findings(docs: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """Every URL mention with its problem: malformed host, double slash, or none."""
    url = F.col("url")
    problem = F.when(~F.rlike(url, F.lit(P.HOST_FORM)), "malformed URL").when(
        F.regexp_count(url, F.lit("//")) > 1, "double-slash in URL"
    )
    return (
        docs.select(F.col(path).alias("path"), F.explode(mentions(F.col(text), P.AUDIT_URL, 0)).alias("raw"))
        .select("path", F.rtrim(F.col("raw"), F.lit(P.AUDIT_URL_TAIL)).alias("url"))
        .select("path", "url", problem.alias("problem"))
    )


def source_verification(findings: DataFrame, required: bool = False) -> DataFrame:
    return gate_result("source_verification", required, findings, F.count(F.lit(1)), F.count("problem"))


# Dates --------------------------------------------------------------------------------------------------------


def date_findings(docs: DataFrame, as_of: Column, path: str = "path", text: str = "text") -> DataFrame:
    """Every valid dated mention, and whether its midnight lies over 183 days before ``as_of``."""
    t = F.col(text)

    def found_by(pattern: str, form: str) -> Column:
        return F.transform(mentions(t, pattern, 0), lambda m: F.struct(m.alias("mention"), F.lit(form).alias("form")))

    rows = docs.select(F.col(path).alias("path"), F.explode(F.concat(found_by(P.AUDIT_DATE_ISO, YMD), found_by(P.AUDIT_DATE_WRITTEN, WRITTEN))).alias("m"))
    found = with_date(rows.select("path", "m.mention", "m.form"), "mention", "form", "date").drop("form")
    # As rows of an array, so that the filter on dates is not moved below where they are made.
    found = found.select("path", "mention", F.explode(F.array("date")).alias("date"))
    cutoff = as_of.cast("timestamp") - F.make_dt_interval(F.lit(P.STALE_AFTER_DAYS))
    return found.where(F.col("date").isNotNull()).select(
        "path", "mention", "date", (F.col("date").cast("timestamp") < cutoff).alias("stale")
    )


def recency_check(findings: DataFrame, required: bool = False) -> DataFrame:
    return gate_result("recency_check", required, findings, F.count(F.lit(1)), F.count_if("stale"))


# One pass -----------------------------------------------------------------------------------------------------


def mention_counts(docs: DataFrame, as_of: Column, path: str = "path", text: str = "text") -> DataFrame:
    """E1, E3, E4 from one reading of the documents: kind (citation, url, date), key, n, n_failed.

    A citation's key is its text in lower case, whether it holds is not known here; URLs and dates are judged where they are found, and their key
    is NULL. Counts combine before the shuffle, so what leaves the documents is one row per distinct citation and kind.
    """
    t = F.col(text)

    def found(pattern: str, kind: str, form: str) -> Column:
        return F.transform(mentions(t, pattern, 0), lambda m: F.struct(F.lit(kind).alias("kind"), m.alias("raw"), F.lit(form).alias("form")))

    every = F.concat(
        found(P.CITATION_ARTICLE, "citation", ""),
        found(P.CITATION_SECTION, "citation", ""),
        found(P.AUDIT_URL, "url", ""),
        found(P.AUDIT_DATE_ISO, "date", YMD),
        found(P.AUDIT_DATE_WRITTEN, "date", WRITTEN),
    )
    rows = with_date(docs.select(F.explode(every).alias("m")).select("m.*"), "raw", "form", "date")
    url = F.rtrim(F.col("raw"), F.lit(P.AUDIT_URL_TAIL))
    bad_url = ~F.rlike(url, F.lit(P.HOST_FORM)) | (F.regexp_count(url, F.lit("//")) > 1)
    stale = F.col("date").cast("timestamp") < as_of.cast("timestamp") - F.make_dt_interval(F.lit(P.STALE_AFTER_DAYS))
    # As rows of an array, so that the filter on dates is not moved below where they are made.
    judged = F.struct("kind", "date", F.when(F.col("kind") == "citation", F.lower("raw")).alias("key"), F.when(F.col("kind") == "url", bad_url).when(F.col("kind") == "date", stale).alias("failed"))
    rows = rows.select(F.explode(F.array(judged)).alias("m")).select("m.*").where((F.col("kind") != "date") | F.col("date").isNotNull())
    return rows.groupBy("kind", "key").agg(F.count(F.lit(1)).alias("n"), F.count_if("failed").alias("n_failed"))


#: The gate that judges each kind of mention.
GATES = {"citation": "citation_audit", "url": "source_verification", "date": "recency_check"}


def mention_gates(counts: DataFrame, sources: DataFrame) -> DataFrame:
    """The results of the three gates from ``mention_counts``, which is read once; citations are looked up in the sources."""
    known = citation_index(sources).select(F.col("ref_key").alias("key"), F.lit(True).alias("found"))
    judged = counts.join(known, "key", "left")
    missing = F.when((F.col("kind") == "citation") & F.col("found").isNull(), F.col("n")).otherwise(F.col("n_failed"))
    kinds = sources.sparkSession.createDataFrame([(k,) for k in GATES], "kind string")
    sums = judged.groupBy("kind").agg(F.sum("n").alias("n_checked"), F.sum(missing).alias("n_failed"))
    gate = F.create_map(*[F.lit(x) for pair in GATES.items() for x in pair])
    rows = kinds.join(sums, "kind", "left").select(F.element_at(gate, F.col("kind")).alias("name"), "n_checked", "n_failed")
    there = sources.agg(F.count(F.lit(1)) > 0).scalar()
    idle = (F.col("name") == "citation_audit") & ~there
    done = _by_profile("", rows, idle)
    return done.select(F.col("name").alias("gate_type"), F.lit(False).alias("required"), "passed", "skipped", "n_checked", "n_failed", "details")


# Scope --------------------------------------------------------------------------------------------------------


def scope_findings(changed: DataFrame, prefixes: list[str], path: str = "path") -> DataFrame:
    """E5: changed files outside every allowed prefix; backslashes count as slashes.

    The prefixes are a short setting of one gate, so they become one expression and no join is needed.
    """
    unified = F.replace(F.col(path), F.lit("\\"), F.lit("/"))
    inside = [F.startswith(unified, F.lit(p.replace("\\", "/"))) for p in prefixes]
    return changed.where(F.length(F.trim(F.col(path))) > 0).select(
        F.col(path).alias("path"), reduce(Column.__or__, inside, F.lit(False)).alias("inside")
    )


def scope_findings_by_table(changed: DataFrame, prefixes: DataFrame, path: str = "path", prefix: str = "prefix") -> DataFrame:
    """E5 for a table of prefixes of any size: a path is inside when one of its own beginnings is a prefix.

    Beginnings are matched by equality, and only those as long as some prefix, so no path meets every prefix.
    """
    allowed = prefixes.select(F.replace(F.col(prefix), F.lit("\\"), F.lit("/")).alias("start")).distinct()
    unified = changed.where(F.length(F.trim(F.col(path))) > 0).select(
        F.col(path).alias("path"), F.replace(F.col(path), F.lit("\\"), F.lit("/")).alias("unified")
    )
    lengths = allowed.agg(F.collect_set(F.length("start")))
    starts = unified.distinct().withColumn("lengths", lengths.scalar()).select(
        "path", F.explode(F.transform("lengths", lambda n: F.left(F.col("unified"), n))).alias("start")
    )
    hit = starts.join(allowed, "start", "left_semi").select("path").distinct().withColumn("hit", F.lit(True))
    return unified.join(hit, "path", "left").select("path", F.coalesce("hit", F.lit(False)).alias("inside"))


def scope_validation(findings: DataFrame, any_prefix: bool, required: bool = True) -> DataFrame:
    """E5: skipped where no prefix is given, and without a changed file."""
    return gate_result(
        "scope_validation",
        required,
        findings,
        F.count(F.lit(1)),
        F.count_if(~F.col("inside")),
        skipped=F.lit(not any_prefix) | (F.count(F.lit(1)) == 0),
    )


def _by_profile(gate_type: str, counted: DataFrame, idle: Column) -> DataFrame:
    """Results per profile from (name, n_checked, n_failed)."""
    filled = counted.na.fill({"n_checked": 0, "n_failed": 0}).withColumn("skipped", idle | (F.col("n_checked") == 0))
    count = F.format_string("%d checked, %d failed", "n_checked", "n_failed")
    return filled.select(
        "name",
        F.lit(gate_type).alias("gate_type"),
        (F.col("skipped") | (F.col("n_failed") == 0)).alias("passed"),
        "skipped",
        "n_checked",
        "n_failed",
        F.when(F.col("skipped"), "nothing to check").otherwise(count).alias("details"),
    )


def citation_audit_by_profile(counts: DataFrame, sources: DataFrame, names: DataFrame, truths: DataFrame) -> DataFrame:
    """E2 per profile: citations of all documents, from ``mention_counts``, against the sources of each profile; skipped where none of these exists.

    ``truths`` (name, path) lists the sources of profiles. Each source is read once, however many profiles name it: citations are added up per
    set of sources that hold them, and these sums are looked up once per set of sources that profiles name.
    """
    counted = counts.where("kind = 'citation'").select(F.col("key").alias("ref_key"), "n")
    named = truths.where(F.col("path").isNotNull() & F.col("name").isNotNull())
    used = sources.join(named.select("path").distinct(), "path", "left_semi")
    present = used.select("path").distinct()
    sets = named.distinct().join(present, "path").groupBy("name").agg(F.sort_array(F.collect_set("path")).alias("paths"))
    known = citation_index(used, "text", ["path"])
    holders = counted.join(known, "ref_key").groupBy("ref_key").agg(F.first("n").alias("n"), F.sort_array(F.collect_set("path")).alias("holders"))
    holders = holders.groupBy("holders").agg(F.sum("n").alias("n")).select("holders", "n", F.explode("holders").alias("path"))
    met = sets.select("paths").distinct().select("paths", F.explode("paths").alias("path")).join(holders, "path")
    found = met.select("paths", "holders", "n").distinct().groupBy("paths").agg(F.sum("n").alias("n_found"))
    per_name = sets.join(found, "paths", "left").select("name", "n_found", F.lit(True).alias("there"))
    total = counted.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_checked"))
    per = names.withColumn("n_checked", total.scalar()).join(per_name, "name", "left")
    per = per.withColumn("n_failed", F.col("n_checked") - F.coalesce("n_found", F.lit(0)))
    return _by_profile("citation_audit", per.drop("n_found"), F.col("there").isNull())


def scope_validation_by_profile(changed: DataFrame, names: DataFrame, prefixes: DataFrame) -> DataFrame:
    """E5 per profile, for prefixes (name, prefix); skipped where a profile has none. A path is looked up by its beginnings.

    Paths are added up per prefix, whatever profiles name it. Of a profile's prefixes only those count that no other of its prefixes begins, so
    a path is inside of one of them at most and sums of theirs are exact.
    """
    unified = lambda c: F.replace(F.col(c), F.lit("\\"), F.lit("/"))
    paths = changed.where(F.length(F.trim("path")) > 0).select(unified("path").alias("unified"))
    allowed = prefixes.select("name", unified("prefix").alias("start")).distinct()
    lengths = allowed.agg(F.collect_set(F.length("start"))).scalar()
    fits = F.filter("lengths", lambda n: n <= F.length("unified"))
    counted = paths.groupBy("unified").agg(F.count(F.lit(1)).alias("n")).withColumn("lengths", lengths)
    starts = counted.select("n", F.explode(F.transform(fits, lambda n: F.left("unified", n))).alias("start"))
    inside = starts.join(allowed.select("start").distinct(), "start", "left_semi").groupBy("start").agg(F.sum("n").alias("n"))
    begun = lambda p, all_of: F.exists(all_of, lambda q: (q != p) & F.startswith(p, q))
    own = allowed.groupBy("name").agg(F.collect_set("start").alias("own"))
    least = own.select("name", F.explode(F.filter("own", lambda p: ~begun(p, F.col("own")))).alias("start"))
    hits = least.join(inside, "start").groupBy("name").agg(F.sum("n").alias("n_inside"))
    has = allowed.select("name").distinct().withColumn("has", F.lit(True))
    per = names.withColumn("n_checked", paths.agg(F.count(F.lit(1))).scalar()).join(hits, "name", "left").join(has, "name", "left")
    per = per.withColumn("n_failed", F.col("n_checked") - F.coalesce("n_inside", F.lit(0)))
    return _by_profile("scope_validation", per, F.col("has").isNull())


def log_gates(logs: DataFrame) -> DataFrame:
    """Results of gates from logs (gate_type, exit_code, output) of tests and linters, one per gate type."""
    judged = logs.withColumn("verdict", log_verdict(F.col("exit_code"), F.col("output")))
    failed, ran = F.count_if(F.col("verdict") == "FAIL"), F.count_if(F.col("verdict") != "SKIP")
    return judged.groupBy("gate_type").agg(ran.alias("n_checked"), failed.alias("n_failed")).select(
        "gate_type",
        F.lit(False).alias("required"),
        (F.col("n_failed") == 0).alias("passed"),
        (F.col("n_checked") == 0).alias("skipped"),
        "n_checked",
        "n_failed",
        F.format_string("%d logs, %d failed", "n_checked", "n_failed").alias("details"),
    )


# String coverage ----------------------------------------------------------------------------------------------


def locale_keys(files: DataFrame, file: str = "locale_file", json: str = "json") -> DataFrame:
    """Locale files with their kind (object, other, broken) and number of distinct top-level keys."""
    j = F.col(json)
    keys = F.array_distinct(F.json_object_keys(j))
    kind = F.when(keys.isNotNull(), "object").when(F.try_parse_json(j).isNull(), "broken").otherwise("other")
    stem = F.lower(F.regexp_replace(F.regexp_extract(F.col(file), r"([^/\\]+)$", 1), r"(?<=.)\.[^.]*$", ""))
    return files.select(
        *[c for c in files.columns if c != json],
        kind.alias("kind"),
        F.when(keys.isNotNull(), F.size(keys)).alias("n_keys"),
        keys.alias("keys"),
        stem.isin(P.BASE_LOCALES).alias("may_be_base"),
    )


def coverage_findings(keyed: DataFrame, file: str = "locale_file") -> DataFrame:
    """Each locale file against the first base file: too few keys, unparsable, or fine.

    The base is one row, found by an aggregate and attached as a scalar.
    """
    base = keyed.where("may_be_base").agg(
        F.min_by(F.struct(F.col(file).alias("file"), "kind", "n_keys"), file).alias("base")
    )
    problem = F.when(F.col("kind") == "broken", "failed to parse").when(
        (F.col("kind") == "object") & (F.col("n_keys") < F.col("base.n_keys")), "keys missing"
    )
    return (
        keyed.drop("keys", "may_be_base")
        .withColumn("base", base.scalar())
        .withColumn("is_base", F.coalesce(F.col(file) == F.col("base.file"), F.lit(False)))
        .select(
            F.col(file),
            "kind",
            "n_keys",
            F.col("base.n_keys").alias("base_keys"),
            F.col("base.kind").alias("base_kind"),
            "is_base",
            F.when(~F.col("is_base") & (F.col("base.kind") == "object"), problem).alias("problem"),
        )
    )


def string_coverage(findings: DataFrame, required: bool = False) -> DataFrame:
    """Skipped without a base or when the base is no object; fails when the base cannot be parsed."""
    usable = F.bool_or(F.col("base_kind").isin("object", "broken"))
    return gate_result(
        "string_coverage",
        required,
        findings,
        F.count_if(~F.col("is_base")),
        F.count("problem"),
        skipped=~F.coalesce(usable, F.lit(False)),
        failed=F.bool_or(F.col("base_kind") == "broken"),
    )


def missing_keys(entries: DataFrame, base: Column, by: list[str] | None = None) -> DataFrame:
    """Which keys of the base each locale lacks.

    ``entries`` holds (project columns ``by``, ``locale``, ``key``); ``base`` marks rows of the base locale. Every
    locale meets every base key of its project, which is as many rows as present and missing keys together. A project
    has few locales, so they are one row that each of its base keys looks up, and its keys stay where they are.
    """
    by = by or []
    rows = entries.withColumn("_base", base)
    wanted = rows.where("_base").select(*by, "key").distinct()
    locales = rows.where(~F.col("_base")).groupBy(*by).agg(F.collect_set("locale").alias("_locales"))
    looked = wanted.join(locales, by) if by else wanted.withColumn("_locales", locales.select("_locales").scalar())
    present = rows.select(*by, "locale", "key").distinct()
    asked = looked.select(*by, F.explode("_locales").alias("locale"), "key")
    return asked.join(present, [*by, "locale", "key"], "left_anti")


# Verdict ------------------------------------------------------------------------------------------------------


def verdict(results: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Passed, failed and skipped gates, and the exit code.

    1 when a required gate failed, 2 when no gate ran, else 0; no gate at all is 0, labelled ``no_gates``.
    """
    ran = ~F.col("skipped")
    counts = results.groupBy(*(by or [])).agg(
        F.count(F.lit(1)).alias("n_gates"),
        F.count_if(ran & F.col("passed")).alias("n_passed"),
        F.count_if(ran & ~F.col("passed")).alias("n_failed"),
        F.count_if("skipped").alias("n_skipped"),
        F.count_if(ran & ~F.col("passed") & F.col("required")).alias("n_required_failed"),
    )
    label = (
        F.when(F.col("n_gates") == 0, "no_gates")
        .when(F.col("n_required_failed") > 0, "blocked")
        .when(F.col("n_passed") + F.col("n_failed") == 0, "inconclusive")
        .otherwise("passed")
    )
    code = F.when(F.col("verdict") == "blocked", 1).when(F.col("verdict") == "inconclusive", 2).otherwise(0)
    return counts.withColumn("verdict", label).withColumn("exit_code", code)
