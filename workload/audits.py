"""Audits of documents, their verdict, assembly and completeness."""

from __future__ import annotations

from pyspark.sql import functions as F

from docaudit import schemas
from docaudit.operators import assembly, audits
from docaudit.plans import jobs
from docaudit.sources import records
from workload.common import table, text


def _cited(spark, d):
    li = table(spark, d, "lineitem")
    n = F.col("l_linenumber")
    return li.select(
        text("doc", F.col("l_suppkey")).alias("path"),
        text("See SECTION ", F.col("l_orderkey"), ".", n, " and Article  ", F.col("l_partkey"), "(", n, ").").alias("text"),
    )


def _sources(spark, d):
    o = table(spark, d, "orders")
    return o.select(
        text("Section ", F.col("o_orderkey"), ".", 1 + F.col("o_custkey") % 30, ".2; article  ", F.col("o_custkey"),
             "(", 1 + F.col("o_orderkey") % 7, ")").alias("text")
    )


_CITED_SQL = """
    ref AS (SELECT 'doc' || l_suppkey AS path, 'SECTION ' || l_orderkey || '.' || l_linenumber AS ref FROM lineitem
        UNION ALL SELECT 'doc' || l_suppkey, 'Article  ' || l_partkey || '(' || l_linenumber || ')' FROM lineitem),
    src AS (SELECT 'section ' || o_orderkey || '.' || (1 + o_custkey % 30) || '.2' AS s, 'section ' || o_orderkey AS k FROM orders
        UNION ALL SELECT DISTINCT 'article  ' || o_custkey || '(' || (1 + o_orderkey % 7) || ')', 'article  ' || o_custkey FROM orders),
    hit AS (SELECT DISTINCT r.ref FROM (SELECT DISTINCT ref FROM ref) r
            JOIN src ON src.k = regexp_extract(lower(r.ref), '^[a-z]+ +[0-9]+') AND starts_with(src.s, lower(r.ref)))"""


def citation_findings(spark, d):
    return audits.citation_findings(_cited(spark, d), _sources(spark, d))


def citation_gate(spark, d):
    return audits.citation_audit(citation_findings(spark, d), _sources(spark, d), required=True)


def _linked(spark, d):
    p = table(spark, d, "pages")
    k = F.col("page_id") % 6
    url = (
        F.when(k == 0, F.concat("url", F.lit(".),")))
        .when(k == 1, text("https://192.168.0.", F.col("page_id") % 250, "/x"))
        .when(k == 2, F.concat("url", F.lit("//deep")))
        .when(k == 3, text("http://localhost:80", F.col("page_id")))
        .when(k == 4, text("http://user@host-", F.col("page_id"), ".example.com/"))
        .otherwise(F.col("url"))
    )
    return p.select(text("p", F.col("page_id")).alias("path"), text("see <", url, "> or ", F.col("url"), " now").alias("text"))


_URL_SQL = r"""
    page AS (SELECT 'p' || page_id AS path, 'see <' || CASE page_id % 6 WHEN 0 THEN url || '.),'
            WHEN 1 THEN 'https://192.168.0.' || (page_id % 250) || '/x' WHEN 2 THEN url || '//deep'
            WHEN 3 THEN 'http://localhost:80' || page_id WHEN 4 THEN 'http://user@host-' || page_id || '.example.com/'
            ELSE url END || '> or ' || url || ' now' AS txt FROM pages),
    found AS (SELECT path, unnest(regexp_extract_all(txt, '(?i)https?://[A-Za-z0-9][A-Za-z0-9._~:/?#\[\]@!$&''()*+,;=%-]*')) AS raw FROM page),
    trimmed AS (SELECT path, rtrim(raw, '.,;:!?)>"''') AS url FROM found),
    judged AS (SELECT path, url, CASE
        WHEN NOT regexp_matches(url, '(?i)^https?://(localhost|[a-z0-9]([a-z0-9-]*[a-z0-9])?(\.[a-z0-9]([a-z0-9-]*[a-z0-9])?)*\.[a-z]{2,})')
            THEN 'malformed URL'
        WHEN len(regexp_extract_all(url, '//')) > 1 THEN 'double-slash in URL' END AS problem FROM trimmed)"""


def url_findings(spark, d):
    return audits.url_findings(_linked(spark, d))


def url_gate(spark, d):
    return audits.source_verification(url_findings(spark, d))


def _dated(spark, d):
    o = table(spark, d, "orders")
    t = F.col("o_orderdate")
    return o.select(
        text("o", F.col("o_orderkey")).alias("path"),
        text("on ", F.date_format(t, "yyyy-M-dd"), ", due ", F.date_format(t + F.expr("INTERVAL 200 DAYS"), "MMMM d, yyyy"),
             "; not 2023-02-30").alias("text"),
    )


AS_OF = "1998-12-01 00:00:00"
_DATED_SQL = """
    m AS (SELECT 'o' || o_orderkey AS path, strftime(o_orderdate, '%Y-%-m-%d') AS mention, o_orderdate::DATE AS date FROM orders
        UNION ALL SELECT 'o' || o_orderkey, strftime(o_orderdate + INTERVAL 200 DAY, '%B %-d, %Y'), (o_orderdate + INTERVAL 200 DAY)::DATE FROM orders)"""


def date_findings(spark, d):
    return audits.date_findings(_dated(spark, d), F.lit(AS_OF))


def recency_gate(spark, d):
    return audits.recency_check(date_findings(spark, d))


def _changed(spark, d):
    p = table(spark, d, "part")
    slash = F.when(F.col("p_partkey") % 2 == 0, "\\").otherwise("/")
    return p.select(F.concat(F.lower("p_type"), slash, F.replace("p_name", F.lit(" "), F.lit("_")), F.lit("/"), F.col("p_partkey").cast("string")).alias("path"))


PREFIXES = ["economy/", "prom", "standard\\red"]


def scope_findings(spark, d):
    return audits.scope_findings(_changed(spark, d), PREFIXES)


def scope_findings_by_table(spark, d):
    """A folder per line item; of items that came back singly it is the folder of the part, of others another one."""
    changed = _changed(spark, d)
    items = table(spark, d, "lineitem").select(F.col("l_partkey").alias("p_partkey"), ((F.col("l_returnflag") == "R") & (F.col("l_quantity") == 1)).alias("single"))
    folder = text(F.lower("p_type"), "/", F.replace("p_name", F.lit(" "), F.lit("_")), "/")
    folders = items.join(table(spark, d, "part"), "p_partkey").select(F.when(F.col("single"), folder).otherwise(F.concat(F.lit("other/"), folder)).alias("prefix"))
    return audits.scope_findings_by_table(changed, folders)


_CHANGED_SQL = """
    f AS (SELECT lower(p_type) || CASE WHEN p_partkey % 2 = 0 THEN chr(92) ELSE '/' END || replace(p_name, ' ', '_') || '/' || p_partkey AS path,
                 p_partkey, p_type, p_name FROM part)"""


def scope_gate(spark, d):
    return audits.scope_validation(scope_findings(spark, d), any_prefix=True)


def _locale_files(spark, d):
    """One locale file per customer; the first is the base."""
    c = table(spark, d, "customer")
    key, n = F.col("c_custkey"), F.col("c_nationkey")
    body = F.when(key == 0, '{"a":1,"b":{"x":2},"c":3}').otherwise(
        F.when(n % 5 == 0, text('{"a":"', F.col("c_name"), '","b":2}'))
        .when(n % 5 == 1, '{"a":1,"b":2,"c":3,"d":[4]}')
        .when(n % 5 == 2, '{"a":1,"a":2,"b":3}')
        .when(n % 5 == 3, text("[", key, "]"))
        .otherwise('{"a":')
    )
    name = F.when(key == 0, "app/i18n/EN.json").otherwise(text("app/i18n/", key, ".json"))
    return c.select(name.alias("locale_file"), body.alias("json"))


def coverage_findings(spark, d):
    keyed = audits.locale_keys(_locale_files(spark, d))
    return audits.coverage_findings(keyed).select("locale_file", "kind", "n_keys", "base_keys", "is_base", "problem")


def coverage_gate(spark, d):
    return audits.string_coverage(audits.coverage_findings(audits.locale_keys(_locale_files(spark, d))), required=True)


_COVERAGE_SQL = """
    c AS (SELECT CASE WHEN c_custkey = 0 THEN 'app/i18n/EN.json' ELSE 'app/i18n/' || c_custkey || '.json' END AS locale_file,
                 c_custkey = 0 AS is_base, c_nationkey % 5 AS n FROM customer),
    k AS (SELECT locale_file, is_base,
            CASE WHEN is_base OR n < 3 THEN 'object' WHEN n = 3 THEN 'other' ELSE 'broken' END AS kind,
            CASE WHEN is_base THEN 3 WHEN n = 0 THEN 2 WHEN n = 1 THEN 4 WHEN n = 2 THEN 2 END AS n_keys FROM c),
    cov AS (SELECT locale_file, kind, n_keys::INT AS n_keys, 3 AS base_keys, is_base,
            CASE WHEN is_base THEN NULL WHEN kind = 'broken' THEN 'failed to parse'
                 WHEN n_keys < 3 THEN 'keys missing' END AS problem FROM k)"""


def missing_locale_keys(spark, d):
    """Suppliers as projects, statuses as locales, parts as keys; the base is status F."""
    li = table(spark, d, "lineitem")
    entries = li.select(
        F.col("l_suppkey").alias("project"), F.concat("l_linestatus", "l_returnflag").alias("locale"), F.col("l_partkey").alias("key")
    )
    return audits.missing_keys(entries, F.col("locale") == "FA", ["project"])


def gate_verdicts(spark, d):
    """Each event stands for a gate result of its user's run."""
    e = table(spark, d, "events")
    results = e.select(
        F.col("user_id").alias("run"),
        (F.col("event_type") == "purchase").alias("required"),
        (F.col("value") < 100).alias("passed"),
        ((F.col("event_type") != "purchase") | (F.col("user_id") % 10 == 0)).alias("skipped"),
    )
    return audits.verdict(results, ["run"])


# Assembly -----------------------------------------------------------------------------------------------------


def output_matrix(spark, d):
    return assembly.matrix(table(spark, d, "documents"), "source", "lang", "doc_id", ["en", "de", "fr", "es"])


def matrix_gaps(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_returnflag")
    return assembly.matrix_gaps(li, "l_orderkey", "l_returnflag", ["A", "N", "R"])


def assembled_documents(spark, d):
    c = table(spark, d, "conversations")
    return assembly.assemble(c, ["conv_id"], "turn", "text").select("conv_id", "turn", F.md5("text").alias("text_md5"))


def overlaid_settings(spark, d):
    """Each user's last value per event type, completed by a lower layer for types the user never had."""
    e = table(spark, d, "events")
    layers = e.select("user_id", "event_type", F.col("event_id").alias("rank"), "value")
    own = assembly.overlay(layers, ["user_id", "event_type"])
    mixin = table(spark, d, "customer").select(F.col("c_custkey").alias("user_id"), F.lit("refund").alias("event_type"), F.col("c_acctbal").alias("value"))
    more = table(spark, d, "customer").select(F.col("c_custkey").alias("user_id"), F.lit("click").alias("event_type"), F.lit(0.0).alias("value"))
    return assembly.add_only(own, mixin.unionByName(more), ["user_id", "event_type"])


def completeness(spark, d):
    needed = table(spark, d, "customer").select(F.col("c_custkey").alias("name"))
    key = F.col("o_custkey")
    there = table(spark, d, "orders").select(F.when(F.col("o_totalprice") > 400000, key).otherwise(-key).alias("name"))
    return assembly.completeness(needed, there)


def profile_checks(spark, d):
    s = table(spark, d, "supplier")
    k = F.col("s_suppkey") % 3
    body = (
        F.when(k == 0, text('{"domain":"', F.col("s_name"), '","version":"', F.col("s_nationkey"), '"}'))
        .when(k == 1, '{"domain":"research"}')
        .otherwise(text('{"domain": ', F.col("s_name")))
    )
    parsed = s.select(
        text(F.col("s_name"), ".json").alias("file"),
        F.from_json(body, schemas.PROFILE, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("j"),
    ).select("file", "j.*")
    return assembly.profile_checks(parsed)


def _all_mentions(spark, d):
    """All documents of the audits above in one table."""
    return _cited(spark, d).unionByName(_linked(spark, d)).unionByName(_dated(spark, d))


def document_gates(spark, d):
    """The gates over citations, URLs and dates from one reading of the documents."""
    return audits.mention_gates(audits.mention_counts(_all_mentions(spark, d), F.lit(AS_OF)), _sources(spark, d))


def _profiles(spark, d):
    """A profile per supplier, which lists the gates that its key has bits for; some allow folders of changes, some name sources."""
    s = table(spark, d, "supplier")
    k = F.col("s_suppkey")
    gate = lambda bit, body: F.when(F.floor(k / bit) % 2 == 1, body)
    gates = F.concat_ws(
        ",",
        gate(1, F.lit('{"type":"recency_check","mechanism":"deterministic","required":false}')),
        gate(2, F.lit('{"type":"source_verification","mechanism":"deterministic"}')),
        gate(4, F.lit('{"type":"citation_audit","mechanism":"deterministic","required":true}')),
        gate(8, F.lit('{"type":"scope_validation","mechanism":"deterministic","commit_scope":["economy/","prom","standard"]}')),
        gate(16, F.lit('{"type":"review","mechanism":"human"}')),
        gate(32, F.lit('{"type":"lint","mechanism":"deterministic"}')),
    )
    truth = F.when(k % 3 == 0, '{"law":"sources/all.md"}').when(k % 3 == 1, '{"law":"sources/none.md"}').otherwise("{}")
    body = text('{"domain":"d","shared_truth":', truth, ',"quality_gates":[', gates, "]}")
    files = s.select(text("p/", F.col("s_suppkey"), ".json").alias("path"), body.cast("binary").alias("content"), F.lit("2024-01-01").cast("timestamp").alias("modified"))
    return records.parse_profiles(files)


def profile_verdicts(spark, d):
    """The verdict of every supplier's profile over all documents and changes."""
    sources = _sources(spark, d).withColumn("path", F.lit("sources/all.md"))
    locales = spark.createDataFrame([], "locale_file string, json string")
    _, verdicts = jobs.run_gates(_profiles(spark, d), _all_mentions(spark, d), sources, locales, _changed(spark, d), F.lit(AS_OF))
    return verdicts.select("name", "verdict", "exit_code", *[F.col(c).cast("long").alias(c) for c in ("n_passed", "n_failed", "n_skipped")])


def _gate_sql(gate: str, required: str, ctes: str, n: str, failed: str) -> str:
    return f"""WITH {ctes}, g AS ({n.replace("FAILED", failed)})
        SELECT '{gate}' AS gate_type, {required} AS required, n_failed = 0 AS passed, false AS skipped,
               n_checked, n_failed, n_checked || ' checked, ' || n_failed || ' failed' AS details FROM g"""


QUERIES = {
    "citation_findings": (
        citation_findings,
        f"""WITH {_CITED_SQL} SELECT path, ref, count(*) AS n, ref IN (SELECT ref FROM hit) AS found FROM ref GROUP BY path, ref""",
    ),
    "citation_gate": (
        citation_gate,
        _gate_sql("citation_audit", "true", _CITED_SQL, "SELECT count(*) AS n_checked, count(*) FILTER (FAILED) AS n_failed FROM ref",
                  "ref NOT IN (SELECT ref FROM hit)"),
    ),
    "document_gates": (
        document_gates,
        f"""WITH {_CITED_SQL}, {_URL_SQL}, {_DATED_SQL}, g AS (
            SELECT 'citation_audit' AS gate_type, count(*) AS n_checked, count(*) FILTER (ref NOT IN (SELECT ref FROM hit)) AS n_failed FROM ref
            UNION ALL SELECT 'source_verification', count(*), count(problem) FROM judged
            UNION ALL SELECT 'recency_check', count(*), count(*) FILTER (date < DATE '1998-12-01' - 183) FROM m)
        SELECT gate_type, false AS required, n_failed = 0 AS passed, false AS skipped, n_checked, n_failed,
               n_checked || ' checked, ' || n_failed || ' failed' AS details FROM g""",
    ),
    "profile_verdicts": (
        profile_verdicts,
        f"""WITH {_CITED_SQL}, {_URL_SQL}, {_DATED_SQL}, {_CHANGED_SQL},
        x AS (SELECT (SELECT count(*) FILTER (date < DATE '1998-12-01' - 183) > 0 FROM m) AS old, (SELECT count(problem) > 0 FROM judged) AS bad,
                (SELECT count(*) FILTER (ref NOT IN (SELECT ref FROM hit)) > 0 FROM ref) AS missing,
                (SELECT count(*) FILTER (NOT (starts_with(replace(path, chr(92), '/'), 'economy/') OR starts_with(path, 'prom') OR starts_with(path, 'standard'))) > 0 FROM f) AS outside),
        g AS (SELECT s_suppkey AS k, true AS ran, old AS failed, false AS required FROM supplier, x WHERE s_suppkey % 2 = 1
            UNION ALL SELECT s_suppkey, true, bad, false FROM supplier, x WHERE s_suppkey // 2 % 2 = 1
            UNION ALL SELECT s_suppkey, s_suppkey % 3 = 0, missing, true FROM supplier, x WHERE s_suppkey // 4 % 2 = 1
            UNION ALL SELECT s_suppkey, true, outside, true FROM supplier, x WHERE s_suppkey // 8 % 2 = 1
            UNION ALL SELECT s_suppkey, false, false, false FROM supplier, x WHERE s_suppkey // 32 % 2 = 1),
        c AS (SELECT s_suppkey AS k, count(g.k) AS n, count(*) FILTER (ran AND NOT failed) AS n_passed, count(*) FILTER (ran AND failed) AS n_failed,
                count(*) FILTER (NOT ran) AS n_skipped, count(*) FILTER (ran AND failed AND required) AS hard FROM supplier LEFT JOIN g ON g.k = s_suppkey GROUP BY 1)
        SELECT k::VARCHAR AS name, CASE WHEN n = 0 THEN 'no_gates' WHEN hard > 0 THEN 'blocked' WHEN n_passed + n_failed = 0 THEN 'inconclusive' ELSE 'passed' END AS verdict,
               CASE WHEN n = 0 THEN 0 WHEN hard > 0 THEN 1 WHEN n_passed + n_failed = 0 THEN 2 ELSE 0 END::INT AS exit_code, n_passed, n_failed, n_skipped FROM c""",
    ),
    "url_findings": (url_findings, f"WITH {_URL_SQL} SELECT path, url, problem FROM judged"),
    "url_gate": (
        url_gate,
        _gate_sql("source_verification", "false", _URL_SQL, "SELECT count(*) AS n_checked, count(FAILED) AS n_failed FROM judged", "problem"),
    ),
    "date_findings": (
        date_findings,
        f"WITH {_DATED_SQL} SELECT path, mention, date, date < DATE '1998-12-01' - 183 AS stale FROM m",
    ),
    "recency_gate": (
        recency_gate,
        _gate_sql("recency_check", "false", _DATED_SQL, "SELECT count(*) AS n_checked, count(*) FILTER (FAILED) AS n_failed FROM m",
                  "date < DATE '1998-12-01' - 183"),
    ),
    "scope_findings": (
        scope_findings,
        f"""WITH {_CHANGED_SQL} SELECT path, starts_with(replace(path, chr(92), '/'), 'economy/') OR starts_with(path, 'prom')
            OR starts_with(replace(path, chr(92), '/'), 'standard/red') AS inside FROM f""",
    ),
    "scope_gate": (
        scope_gate,
        _gate_sql("scope_validation", "true", _CHANGED_SQL, "SELECT count(*) AS n_checked, count(*) FILTER (FAILED) AS n_failed FROM f",
                  """NOT (starts_with(replace(path, chr(92), '/'), 'economy/') OR starts_with(path, 'prom')
                     OR starts_with(replace(path, chr(92), '/'), 'standard/red'))"""),
    ),
    "scope_findings_by_table": (
        scope_findings_by_table,
        f"""WITH {_CHANGED_SQL}, r AS (SELECT DISTINCT p_type, p_name FROM part
            WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity = 1))
        SELECT path, (p_type, p_name) IN (SELECT (p_type, p_name) FROM r) AS inside FROM f""",
    ),
    "coverage_findings": (coverage_findings, f"WITH {_COVERAGE_SQL} SELECT * FROM cov"),
    "coverage_gate": (
        coverage_gate,
        _gate_sql("string_coverage", "true", _COVERAGE_SQL,
                  "SELECT count(*) FILTER (NOT is_base) AS n_checked, count(FAILED) AS n_failed FROM cov", "problem"),
    ),
    "missing_locale_keys": (
        missing_locale_keys,
        """WITH e AS (SELECT DISTINCT l_suppkey AS project, l_linestatus || l_returnflag AS locale, l_partkey AS key FROM lineitem),
        w AS (SELECT l.project, l.locale, b.key FROM (SELECT DISTINCT project, locale FROM e WHERE locale <> 'FA') l
              JOIN e b ON b.project = l.project AND b.locale = 'FA')
        SELECT * FROM w EXCEPT SELECT * FROM e""",
    ),
    "gate_verdicts": (
        gate_verdicts,
        """WITH r AS (SELECT user_id AS run, event_type = 'purchase' AS required, value < 100 AS passed,
                      event_type <> 'purchase' OR user_id % 10 = 0 AS skipped FROM events),
        c AS (SELECT run, count(*) AS n_gates, count(*) FILTER (NOT skipped AND passed) AS n_passed,
                count(*) FILTER (NOT skipped AND NOT passed) AS n_failed, count(*) FILTER (skipped) AS n_skipped,
                count(*) FILTER (NOT skipped AND NOT passed AND required) AS n_required_failed FROM r GROUP BY run)
        SELECT *, CASE WHEN n_required_failed > 0 THEN 'blocked' WHEN n_skipped = n_gates THEN 'inconclusive' ELSE 'passed' END AS verdict,
            CASE WHEN n_required_failed > 0 THEN 1 WHEN n_skipped = n_gates THEN 2 ELSE 0 END::INT AS exit_code FROM c""",
    ),
    "output_matrix": (
        output_matrix,
        """SELECT source, min(doc_id) FILTER (lang = 'en') AS en, min(doc_id) FILTER (lang = 'de') AS de,
            min(doc_id) FILTER (lang = 'fr') AS fr, min(doc_id) FILTER (lang = 'es') AS es FROM documents GROUP BY source""",
    ),
    "matrix_gaps": (
        matrix_gaps,
        """WITH w AS (SELECT DISTINCT l_orderkey, unnest(['A', 'N', 'R']) AS l_returnflag FROM lineitem)
        SELECT * FROM w EXCEPT SELECT l_orderkey, l_returnflag FROM lineitem""",
    ),
    "assembled_documents": (
        assembled_documents,
        "SELECT conv_id, turn, md5(text) AS text_md5 FROM conversations",
    ),
    "overlaid_settings": (
        overlaid_settings,
        """WITH own AS (SELECT user_id, event_type, arg_max(value, event_id) AS value, max(event_id) AS rank FROM events GROUP BY 1, 2),
        mix AS (SELECT c_custkey AS user_id, 'refund' AS event_type, c_acctbal AS value FROM customer
                UNION ALL SELECT c_custkey, 'click', 0.0 FROM customer)
        SELECT user_id, event_type, value, rank FROM own
        UNION ALL SELECT m.user_id, m.event_type, m.value, NULL FROM mix m ANTI JOIN own USING (user_id, event_type)""",
    ),
    "completeness": (
        completeness,
        """SELECT c_custkey AS name, c_custkey IN (SELECT CASE WHEN o_totalprice > 400000 THEN o_custkey ELSE -o_custkey END FROM orders) AS present FROM customer""",
    ),
    "profile_checks": (
        profile_checks,
        """SELECT s_name || '.json' AS file, s_suppkey % 3 <> 2 AS valid,
            CASE s_suppkey % 3 WHEN 0 THEN s_name WHEN 1 THEN 'research' END AS domain,
            CASE s_suppkey % 3 WHEN 0 THEN s_nationkey::VARCHAR WHEN 1 THEN 'unknown' END AS version FROM supplier""",
    ),
}
