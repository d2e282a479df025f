"""Sources: files of JSON records, their content built from the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from docaudit.operators import profiles
from docaudit.sources import records
from workload.common import table, text


def _files(rows, path, body):
    return rows.select(path.alias("path"), body.cast("binary").alias("content"), F.lit("2024-01-01").cast("timestamp").alias("modified"))


def claims_files(spark, d):
    """Claims files of suppliers; some are broken, some hold other types than they should."""
    s = table(spark, d, "supplier")
    k = F.col("s_suppkey") % 5
    body = (
        F.when(k == 0, text('{"claims":[{"entity":"', F.col("s_name"), '","attribute":"numeric","value":', F.col("s_nationkey"), ',"confidence":"high"},{"value":"v"}]}'))
        .when(k == 1, text('{"claims":[{"entity":"', F.col("s_name"), '","confidence":0.5,"source":"', F.col("s_suppkey"), '"}],"more":1}'))
        .when(k == 2, '{"claims":7}')
        .when(k == 3, '{"other":[]}')
        .otherwise(text('{"claims":[', F.col("s_name")))
    )
    parsed = records.parse_claims(_files(s, text(F.col("s_name"), ".claims.json"), body))
    return parsed.select("path", F.inline("claims")).select("path", "entity", "attribute", "value", "confidence", "source")


def profile_gates(spark, d):
    """Gates of profiles, one profile per supplier."""
    s = table(spark, d, "supplier")
    k = F.col("s_suppkey") % 3
    gates = (
        F.when(k == 0, '[{"type":"scope_validation","mechanism":"deterministic","commit_scope":["src/","docs"]},{"type":"review","mechanism":"heuristic"}]')
        .when(k == 1, text('[{"mechanism":"deterministic","required":', F.when(F.col("s_nationkey") % 2 == 0, "true").otherwise('"no"'), '},{"type":"lint","mechanism":"deterministic"}]'))
        .otherwise("[]")
    )
    profiles = records.parse_profiles(_files(s, text("p/", F.col("s_name"), ".json"), text('{"domain":3,"quality_gates":', gates, "}")))
    return records.deterministic_gates(profiles).select("name", F.col("ord").cast("long").alias("ord"), "gate_type", "required", F.concat_ws("|", "commit_scope").alias("scope"))


def track_records(spark, d):
    """Tracks with metadata, with a plan, with both; some metadata is no JSON object."""
    s = table(spark, d, "supplier")
    k = F.col("s_suppkey") % 4
    body = F.when(k == 0, "[1]").when(k == 1, text('{"status":"active","github_issue":{"number":"', F.col("s_suppkey"), '"}}')).otherwise(text('{"status":', F.col("s_nationkey"), ',"github_issue":"none"}'))
    meta = _files(s.where(k < 3), text("t/", F.col("s_name"), "/metadata.json"), body)
    plans = _files(s.where(k > 1), text("t/", F.col("s_name"), "/plan.md"), text("- [x] ", F.col("s_name")))
    found = records.parse_tracks(meta.unionByName(plans))
    return found.select("track_id", "status", F.col("github_issue.number").alias("number"), "metadata_error", "plan")


def overlaid_profiles(spark, d):
    """The leaves of a profile per supplier: a base by nation, what the supplier sets over it, and a mixin that adds only."""
    s = table(spark, d, "supplier")
    k, n = F.col("s_suppkey"), F.col("s_nationkey")
    base = text('{"budget":{"limit":', n, ',"phases":{"cap":6}},"gates":[1,2],"mode":"base","open":{"x":1}}')
    own = (
        F.when(k % 3 == 0, text('{"budget":{"limit":', k, '},"gates":[3],"open":7}'))
        .when(k % 3 == 1, text('{"budget":{"phases":{"cap":9,"own":"', F.col("s_name"), '"}},"open":{}}'))
        .otherwise('{"budget":null}')
    )
    mixin = F.lit('{"budget":{"extra":true},"gates":[9],"more":{"a":[{"b":1}]}}')
    layers = [s.select(F.col("s_name").alias("name"), F.lit(rank).alias("rank"), body.alias("text")) for rank, body in ((1, base), (2, own), (0, mixin))]
    leaves = profiles.overlaid_leaves(layers[0].unionByName(layers[1]).unionByName(layers[2]), ["name"])
    return leaves.select("name", F.array_join("path", ".").alias("path"), "value")


QUERIES = {
    "overlaid_profiles": (
        overlaid_profiles,
        """WITH s AS (SELECT s_name AS name, s_suppkey AS k, s_nationkey AS n FROM supplier)
        SELECT name, 'budget.limit' AS path, CASE k % 3 WHEN 0 THEN k ELSE n END::VARCHAR AS value FROM s WHERE k % 3 < 2
        UNION ALL SELECT name, 'budget.phases.cap', CASE k % 3 WHEN 0 THEN '6' ELSE '9' END FROM s WHERE k % 3 < 2
        UNION ALL SELECT name, 'budget.phases.own', '"' || name || '"' FROM s WHERE k % 3 = 1
        UNION ALL SELECT name, 'budget.extra', 'true' FROM s WHERE k % 3 < 2
        UNION ALL SELECT name, 'budget', 'null' FROM s WHERE k % 3 = 2
        UNION ALL SELECT name, 'gates', CASE k % 3 WHEN 0 THEN '[3]' ELSE '[1,2]' END FROM s
        UNION ALL SELECT name, 'mode', '"base"' FROM s
        UNION ALL SELECT name, CASE k % 3 WHEN 0 THEN 'open' ELSE 'open.x' END, CASE k % 3 WHEN 0 THEN '7' ELSE '1' END FROM s
        UNION ALL SELECT name, 'more.a', '[{"b":1}]' FROM s""",
    ),
    "claims_files": (
        claims_files,
        """SELECT s_name || '.claims.json' AS path, s_name AS entity, CASE WHEN s_suppkey % 5 = 0 THEN 'numeric' END AS attribute,
            CASE WHEN s_suppkey % 5 = 0 THEN s_nationkey::VARCHAR END AS value, CASE WHEN s_suppkey % 5 = 1 THEN 0.5::DOUBLE END AS confidence,
            CASE WHEN s_suppkey % 5 = 1 THEN s_suppkey::VARCHAR END AS source FROM supplier WHERE s_suppkey % 5 < 2
        UNION ALL SELECT s_name || '.claims.json', NULL, NULL, 'v', NULL, NULL FROM supplier WHERE s_suppkey % 5 = 0""",
    ),
    "profile_gates": (
        profile_gates,
        """SELECT s_name AS name, 0::BIGINT AS ord, CASE s_suppkey % 3 WHEN 0 THEN 'scope_validation' ELSE 'unknown' END AS gate_type,
            true AS required, CASE s_suppkey % 3 WHEN 0 THEN 'src/|docs' ELSE '' END AS scope
        FROM supplier WHERE s_suppkey % 3 < 2
        UNION ALL SELECT s_name, 1, 'lint', false, '' FROM supplier WHERE s_suppkey % 3 = 1""",
    ),
    "track_records": (
        track_records,
        """SELECT s_name AS track_id, CASE s_suppkey % 4 WHEN 1 THEN 'active' WHEN 2 THEN s_nationkey::VARCHAR END AS status,
            CASE WHEN s_suppkey % 4 = 1 THEN s_suppkey END AS number, CASE WHEN s_suppkey % 4 = 0 THEN 'not a JSON object' END AS metadata_error,
            CASE WHEN s_suppkey % 4 > 1 THEN '- [x] ' || s_name END AS plan FROM supplier""",
    ),
}
