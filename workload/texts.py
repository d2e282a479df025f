"""Sanitising, file classes, log verdicts, small text functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from docaudit.functions import text as X
from docaudit.operators import assembly, passages, sanitizing
from workload.common import longs, table, text

ZERO_WIDTH = "\u200b"

# The SQL side spells out what hidden content and injected lines are.
_COMMENT = "(?s)<!--.*?-->"
_INVISIBLE = "[\\x{200B}\\x{200C}\\x{200D}\\x{FEFF}\\x{2060}-\\x{2064}\\x{180E}\\x{AD}]+"
_ENDS = "\\n\\r\\x0B\\x0C\\x1C\\x1D\\x1E\\x{85}\\x{2028}\\x{2029}"
_LINE = f"[^{_ENDS}]*(?:\\r\\n|[{_ENDS}])|[^{_ENDS}]+"
_INJECTED = (
    "(?i)^\\s*(IGNORE\\s+ALL\\s+PREVIOUS\\s+INSTRUCTIONS\\b|DISREGARD\\s+(ALL\\s+)?PREVIOUS\\b"
    "|FORGET\\s+(ALL\\s+)?(PREVIOUS|PRIOR|ABOVE)\\b|You\\s+are\\s+now\\b|SYSTEM\\s*:|ASSISTANT\\s*:"
    "|NEW\\s+INSTRUCTIONS?\\s*:|BEGIN\\s+NEW\\s+PROMPT\\b|<\\|im_start\\|>|<\\|system\\|>)"
)


def _sanitized_sql(source: str, keys: str) -> str:
    return f"""
    t0 AS ({source}),
    t1 AS (SELECT {keys}, len(regexp_extract_all(txt, '{_COMMENT}')) AS n_comments,
                  regexp_replace(txt, '{_COMMENT}', '', 'g') AS txt FROM t0),
    t2 AS (SELECT {keys}, n_comments, len(regexp_extract_all(txt, '{_INVISIBLE}')) AS n_invisible,
                  regexp_extract_all(regexp_replace(txt, '{_INVISIBLE}', '', 'g'), '{_LINE}') AS lines FROM t1),
    t3 AS (SELECT {keys}, n_comments, n_invisible,
                  list_filter(lines, lambda x: NOT regexp_matches(x, '{_INJECTED}')) AS kept, len(lines) AS n FROM t2),
    t4 AS (SELECT {keys}, n_comments, n_invisible, n - len(kept) AS n_injections,
                  array_to_string(kept, '') AS clean_text FROM t3)"""


_SUMMARY_SQL = """
    SELECT count(*) AS n_scanned,
           count(*) FILTER (n_comments + n_invisible + n_injections = 0) AS n_clean,
           sum(n_comments)::BIGINT AS n_comments, sum(n_invisible)::BIGINT AS n_invisible,
           sum(n_injections)::BIGINT AS n_injections,
           count(*) FILTER (n_comments + n_invisible + n_injections > 0) AS n_with_issues,
           max((n_comments + n_invisible + n_injections > 0)::INT)::INT AS flag
    FROM t4"""


def sanitized_pages(spark, d):
    return sanitizing.sanitize(table(spark, d, "pages").select("page_id", F.col("html").alias("text"))).select(
        "page_id", *[F.col(c).cast("long").alias(c) for c in ("n_comments", "n_invisible", "n_injections")],
        F.md5(F.col("clean_text")).alias("clean_md5"),
    )


def sanitizing_summary(spark, d):
    pages = table(spark, d, "pages").select(F.col("html").alias("text"))
    return sanitizing.summarize(sanitizing.sanitize(pages))


def _chat(spark, d):
    c = table(spark, d, "conversations")
    role = F.upper("role")
    split = F.when(
        F.col("turn") % 2 == 0, text(F.left(role, F.lit(3)), ZERO_WIDTH, F.substr(role, F.lit(4)))
    ).otherwise(role)
    return c.select("conv_id", "turn", text("start\r\n", split, ": ", F.col("text"), "\n\nend").alias("text"))


def sanitized_chats(spark, d):
    out = sanitizing.sanitize(_chat(spark, d))
    return longs(
        out.select(
            "conv_id", "turn", "n_comments", "n_invisible", "n_injections", F.md5("clean_text").alias("clean_md5"), "dirty"
        ),
        "n_comments", "n_invisible", "n_injections",
    )


_CHAT_SQL = """SELECT conv_id, turn, 'start' || chr(13) || chr(10) ||
    CASE WHEN turn % 2 = 0 THEN substr(upper(role), 1, 3) || chr(8203) || substr(upper(role), 4) ELSE upper(role) END
    || ': ' || text || chr(10) || chr(10) || 'end' AS txt FROM conversations"""


def split_lines(spark, d):
    lines = table(spark, d, "documents").select("doc_id", F.posexplode(X.split_lines(F.col("text"))).alias("pos", "line"))
    return lines.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n_lines"), F.sum(F.length("line")).alias("n_chars"),
        F.sum(F.length("line") * (F.col("pos") + 1)).alias("weighted"),
    )


def log_verdicts(spark, d):
    e = table(spark, d, "events")
    n = F.col("event_id") % 12
    output = (
        F.when(F.col("event_type") == "error", text(n, " Tests run"))
        .when(F.col("event_type") == "view", "Error:  no test specified")
        .when(F.col("event_type") == "click", "No  tests\tfound")
        .otherwise(text(n, " passed"))
    )
    verdict = X.log_verdict((F.col("event_id") % 2).cast("int"), output)
    return e.groupBy("event_type", verdict.alias("verdict")).count().withColumnRenamed("count", "n")


def withheld_secrets(spark, d):
    c = table(spark, d, "customer")
    name = F.get(F.array(*map(F.lit, ["GH_TOKEN", " GITHUB_TOKEN ", "REGION", "gh_token"])), F.col("c_custkey").cast("int") % 4)
    line = F.when(F.col("c_custkey") % 7 == 0, name).otherwise(text(name, "=", F.col("c_name")))
    return sanitizing.withhold_secrets(c.select("c_custkey", line.alias("line")))


def previews_and_headings(spark, d):
    t = F.col("text")
    marked = F.when(F.col("doc_id") % 3 == 0, text("intro\n# Title ", F.col("doc_id"), "\n", t)).otherwise(t)
    return table(spark, d, "documents").select(
        "doc_id", X.preview(t).alias("preview"), X.first_heading(marked).alias("heading")
    )


def file_classes(spark, d):
    p = table(spark, d, "pages")
    ext = F.get(F.array(*map(F.lit, ["md", "TXT", "pdf", "bin", "dat"])), F.col("page_id").cast("int") % 5)
    content = F.when(F.col("page_id") % 5 == 4, F.concat(F.encode("html", "UTF-8"), F.unhex(F.lit("FF")))).otherwise(
        F.encode("html", "UTF-8")
    )
    files = p.select(text("in/p", F.col("page_id"), ".", ext).alias("path"), content.alias("content"))
    out = sanitizing.classify_files(files)
    return out.groupBy(X.suffix(F.col("path")).alias("suffix"), "kind").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("n_chars")
    )


def shared_passages(spark, d):
    docs = table(spark, d, "documents")
    lines = docs.select("source", F.explode(F.split("text", "\n")).alias("line"))
    return assembly.shared_passages(lines, "source", "line").select("passage", "n_sources", "n_copies", "first_source")


def near_passages(spark, d):
    docs = table(spark, d, "documents")
    lines = docs.select("source", F.explode(F.split("text", "\n")).alias("line"))
    return passages.near_passages(lines, "source", "line")


QUERIES = {
    "near_passages": (
        near_passages,
        """WITH RECURSIVE l AS (SELECT source, unnest(string_split(text, chr(10))) AS line FROM documents),
        k AS (SELECT source, trim(regexp_replace(lower(line), '[^\\p{L}\\p{N}]+', ' ', 'g')) AS form FROM l),
        f AS (SELECT form, row_number() OVER (ORDER BY form) AS id, string_split(form, ' ') AS w FROM (SELECT DISTINCT form FROM k WHERE form <> '')),
        s AS (SELECT DISTINCT id, array_to_string(w[i:i + 2], ' ') AS shingle FROM (SELECT id, w, unnest(range(1, greatest(len(w) - 1, 2))) AS i FROM f)),
        n AS (SELECT id, count(*) AS n FROM s GROUP BY id),
        p AS (SELECT a.id AS a, b.id AS b, count(*) AS c FROM s a JOIN s b ON a.shingle = b.shingle AND a.id < b.id GROUP BY 1, 2),
        e AS (SELECT a, b FROM p JOIN n x ON x.id = a JOIN n y ON y.id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
        both_ways AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
        r AS (SELECT a AS id, a AS reached FROM both_ways UNION SELECT r.id, b FROM r JOIN both_ways ON a = reached),
        c AS (SELECT id, min(reached) AS class FROM r GROUP BY id),
        g AS (SELECT coalesce(c.class, f.id) AS class, f.id, f.form, source FROM k JOIN f USING (form) LEFT JOIN c ON c.id = f.id)
        SELECT min(form) AS passage, count(DISTINCT id) AS n_forms, count(DISTINCT source) AS n_sources, count(*) AS n_copies, min(source) AS first_source
        FROM g GROUP BY class HAVING count(DISTINCT source) > 1""",
    ),
    "sanitized_pages": (
        sanitized_pages,
        f"""WITH {_sanitized_sql("SELECT page_id, html AS txt FROM pages", "page_id")}
        SELECT page_id, n_comments::BIGINT AS n_comments, n_invisible::BIGINT AS n_invisible,
               n_injections::BIGINT AS n_injections, md5(clean_text) AS clean_md5 FROM t4""",
    ),
    "sanitizing_summary": (
        sanitizing_summary,
        f"""WITH {_sanitized_sql("SELECT page_id, html AS txt FROM pages", "page_id")} {_SUMMARY_SQL}""",
    ),
    "sanitized_chats": (
        sanitized_chats,
        f"""WITH {_sanitized_sql(_CHAT_SQL, "conv_id, turn")}
        SELECT conv_id, turn, n_comments::BIGINT AS n_comments, n_invisible::BIGINT AS n_invisible,
               n_injections::BIGINT AS n_injections, md5(clean_text) AS clean_md5,
               n_comments + n_invisible + n_injections > 0 AS dirty FROM t4""",
    ),
    "split_lines": (
        split_lines,
        f"""WITH l AS (SELECT doc_id, regexp_extract_all(text, '{_LINE}') AS lines FROM documents),
        x AS (SELECT doc_id, unnest(lines) AS line, unnest(range(1, len(lines) + 1)) AS pos FROM l)
        SELECT doc_id, count(*) AS n_lines, sum(length(line))::BIGINT AS n_chars,
               sum(length(line) * pos)::BIGINT AS weighted FROM x GROUP BY doc_id""",
    ),
    "log_verdicts": (
        log_verdicts,
        """SELECT event_type,
            CASE WHEN event_id % 2 = 1 THEN 'FAIL'
                 WHEN event_type IN ('view', 'click') THEN 'SKIP'
                 WHEN event_type = 'error' AND event_id % 12 = 0 THEN 'SKIP'
                 ELSE 'PASS' END AS verdict, count(*) AS n
        FROM events GROUP BY ALL""",
    ),
    "withheld_secrets": (
        withheld_secrets,
        """WITH k AS (SELECT c_custkey, c_name, ['GH_TOKEN', ' GITHUB_TOKEN ', 'REGION', 'gh_token'][c_custkey % 4 + 1] AS key
                      FROM customer)
        SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN key
            WHEN trim(key) IN ('GH_TOKEN', 'GITHUB_TOKEN')
                 THEN '# ' || trim(key) || ' left out: secret value'
            ELSE key || '=' || c_name END AS line FROM k""",
    ),
    "previews_and_headings": (
        previews_and_headings,
        """SELECT doc_id, substr(text, 1, 50) || '...' AS preview,
            CASE WHEN doc_id % 3 = 0 THEN 'Title ' || doc_id
                 ELSE coalesce(list_filter(string_split(text, chr(10)), lambda x: starts_with(x, '# '))[1][3:], 'Unknown Product')
            END AS heading FROM documents""",
    ),
    "file_classes": (
        file_classes,
        """WITH f AS (SELECT page_id, html, ['md', 'txt', 'pdf', 'bin', 'dat'][page_id % 5 + 1] AS suffix FROM pages)
        SELECT suffix, CASE WHEN suffix IN ('pdf', 'dat') THEN 'binary' ELSE 'text' END AS kind, count(*) AS n,
               CASE WHEN suffix IN ('pdf', 'dat') THEN NULL ELSE sum(length(html))::BIGINT END AS n_chars
        FROM f GROUP BY suffix""",
    ),
    "shared_passages": (
        shared_passages,
        """WITH l AS (SELECT source, unnest(string_split(text, chr(10))) AS line FROM documents),
        k AS (SELECT source, trim(regexp_replace(lower(line), '[^\\p{L}\\p{N}]+', ' ', 'g')) AS passage FROM l)
        SELECT passage, count(DISTINCT source) AS n_sources, count(*) AS n_copies, min(source) AS first_source
        FROM k WHERE passage <> ''
        GROUP BY passage HAVING count(DISTINCT source) > 1""",
    ),
}
