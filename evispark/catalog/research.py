"""Research sections, sources, outlines and reports over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from evispark import schemas
from evispark.catalog.registry import query
from evispark.functions import arrays as A
from evispark.operators import research as R
from evispark.operators import requests as Q
from evispark.operators import rules
from evispark.operators import stores as S
from evispark.session import table

# A part is one write of a section; its brand is the project.
DOTTED_SQL = """CASE p_partkey % 3 WHEN 0 THEN p_size::VARCHAR WHEN 1 THEN p_size || '.' || (p_partkey % 7) ELSE p_size || '.' || (p_partkey % 7) || '.' || (p_partkey % 5) END"""
WRITES_SQL = f"""writes AS (SELECT p_partkey AS k, p_brand AS project_id, {DOTTED_SQL} AS dotted, p_name, p_type, p_size,
   CASE WHEN p_partkey % 11 = 0 THEN '' ELSE {DOTTED_SQL} END AS section_id, CASE WHEN p_partkey % 13 = 0 THEN '' ELSE p_name END AS title,
   trim(repeat(p_name || ' ', p_size)) || CASE WHEN p_partkey % 17 = 0 THEN ' TODO' ELSE '' END AS body,
   p_partkey % 5 = 0 AS no_findings, CASE WHEN p_partkey % 7 = 0 THEN '' ELSE p_name END AS claim1, CASE WHEN p_partkey % 19 = 0 THEN '待补充 x' ELSE p_type END AS claim2,
   'source-' || (p_partkey % 4) AS cited1, p_partkey % 9 = 0 AS uncited, CASE WHEN p_partkey % 23 = 0 THEN '' ELSE p_type END AS risk1,
   CASE WHEN p_partkey % 6 = 0 THEN '' ELSE 'http://e.org/' || (p_partkey % 50) END AS url1, p_partkey % 12 = 0 AS internal1, p_partkey % 8 = 0 AS untitled2 FROM part)"""


def dotted(p):
    size, seven, five = (c.cast("string") for c in (F.col("p_size"), p % 7, p % 5))
    return (
        F.when(p % 3 == 0, size).when(p % 3 == 1, F.concat_ws(".", size, seven)).otherwise(F.concat_ws(".", size, seven, five))
    )


def section_id_of(p):
    return F.when(p % 11 == 0, F.lit("")).otherwise(dotted(p))


def section_writes(spark, sf):
    return written(table(spark, sf, "part"))


def written(parts):
    """The section that each of ``parts`` writes."""
    p = F.col("p_partkey")
    none = F.lit(None).cast("string")
    ids = lambda *xs: F.array(*xs).cast("array<string>")
    finding = lambda claim, summary, sources: F.struct(
        none.alias("finding_id"),
        claim.alias("claim"),
        summary.alias("summary"),
        none.alias("title"),
        sources.alias("source_ids"),
        F.lower(F.substring("p_type", 1, 5)).alias("confidence"),
    )
    cited = F.when(p % 9 == 0, ids(F.lit(" "))).otherwise(ids(F.concat(F.lit(" source-"), (p % 4).cast("string"))))
    findings = F.array(
        finding(F.when(p % 7 == 0, F.lit("")).otherwise(F.col("p_name")), none, cited),
        finding(F.lit(""), F.when(p % 19 == 0, F.lit("待补充 x")).otherwise(F.col("p_type")), ids(F.lit("source-9"))),
    )
    risks = F.array(
        F.struct(
            none.alias("risk_id"),
            F.when(p % 23 == 0, F.lit("")).otherwise(F.col("p_type")).alias("description"),
            none.alias("summary"),
            none.alias("title"),
            ids().alias("source_ids"),
            F.lit("stale_data").alias("risk_type"),
            F.lit("HIGH").alias("severity"),
        )
    )
    sources = F.array(
        F.struct(
            F.concat(F.lit("source-"), (p % 4).cast("string")).alias("source_id"),
            none.alias("id"),
            F.lit("t").alias("title"),
            F.when(p % 6 == 0, F.lit("")).otherwise(F.concat(F.lit("http://e.org/"), (p % 50).cast("string"))).alias("url"),
            none.alias("published_at"),
            F.when(p % 12 == 0, F.lit(R.INTERNAL_SOURCE)).otherwise(F.lit("public_web")).alias("source_type"),
            none.alias("summary"),
        ),
        F.struct(
            none.alias("source_id"),
            F.lit("source-9").alias("id"),
            F.when(p % 8 == 0, F.lit(" ")).otherwise(F.lit("t9")).alias("title"),
            F.lit("https://e.org/nine").alias("url"),
            none.alias("published_at"),
            none.alias("source_type"),
            none.alias("summary"),
        ),
    )
    body = F.concat(
        F.trim(F.repeat(F.concat("p_name", F.lit(" ")), F.col("p_size"))), F.when(p % 17 == 0, F.lit(" TODO")).otherwise(F.lit(""))
    )
    return parts.select(
        p.alias("k"),
        p.alias("seq"),
        "p_type",
        F.col("p_brand").alias("project_id"),
        dotted(p).alias("dotted"),
        section_id_of(p).alias("section_id"),
        F.when(p % 13 == 0, F.lit("")).otherwise(F.col("p_name")).alias("title"),
        F.when(p % 2 == 0, F.concat(F.lit("about "), "p_type")).alias("summary"),
        body.alias("body"),
        F.when(p % 5 == 0, F.array().cast(schemas.SECTION["key_findings"].dataType))
        .otherwise(findings)
        .alias("key_findings"),
        risks.alias("risks"),
        sources.alias("sources"),
    )


OUTLINE_SQL = "nodes AS (SELECT DISTINCT project_id, dotted AS node_id FROM writes WHERE p_type <> 'SMALL')"


def outline_of_writes(spark, sf):
    return section_writes(spark, sf).where("p_type <> 'SMALL'").select("project_id", F.col("dotted").alias("node_id")).distinct()


@query(
    "section_rejects",
    "P17,J9,X6,X7",
    f"""WITH {WRITES_SQL}, {OUTLINE_SQL}, f AS (SELECT w.*, n.node_id IS NOT NULL AS known,
          (NOT no_findings AND NOT uncited) AS cites1, NOT no_findings AS cites9 FROM writes w LEFT JOIN nodes n ON n.project_id = w.project_id AND n.node_id = w.section_id)
        SELECT k, 'section_id_empty' AS reason FROM f WHERE section_id = ''
        UNION ALL SELECT k, 'section_not_in_outline' FROM f WHERE section_id <> '' AND NOT known
        UNION ALL SELECT k, 'title_empty' FROM f WHERE title = ''
        UNION ALL SELECT k, 'body_too_short' FROM f WHERE len(trim(body)) < 120
        UNION ALL SELECT k, 'body_placeholder' FROM f WHERE contains(body, 'TODO')
        UNION ALL SELECT k, 'findings_missing' FROM f WHERE no_findings
        UNION ALL SELECT k, 'claim_empty' FROM f WHERE NOT no_findings AND claim1 = ''
        UNION ALL SELECT k, 'claim_placeholder' FROM f WHERE NOT no_findings AND contains(claim2, '待补充')
        UNION ALL SELECT k, 'finding_without_sources' FROM f WHERE NOT no_findings AND uncited
        UNION ALL SELECT k, 'dangling_sources' FROM f WHERE cites9 AND untitled2
        UNION ALL SELECT k, 'source_without_url' FROM f WHERE url1 = '' AND NOT internal1
        UNION ALL SELECT k, 'cited_source_without_url' FROM f WHERE cites1 AND url1 = '' AND NOT internal1
        UNION ALL SELECT k, 'risk_description_empty' FROM f WHERE risk1 = ''""",
)
def section_rejects(spark, sf):
    flagged = R.in_outline(section_writes(spark, sf), outline_of_writes(spark, sf))
    return rules.rejects(R.with_evidence(flagged), ["k"], R.section_rules(F.col("in_outline")))


@query(
    "section_normalisation",
    "P18,X8",
    f"""WITH {WRITES_SQL} SELECT k, CASE WHEN no_findings THEN '' ELSE concat_ws('|', CASE WHEN claim1 <> '' THEN 'finding-1=' || claim1 || '<' || CASE WHEN uncited THEN '' ELSE cited1 END END,
             'finding-2=' || claim2 || '<source-9') END AS findings,
          CASE WHEN risk1 = '' THEN '' ELSE 'risk-1=' || risk1 || '/stale_data/high' END AS risks,
          concat_ws('|', cited1 || '=' || CASE WHEN internal1 THEN 'internal_knowledge_base' ELSE 'public_web' END || '=' || CASE WHEN url1 = '' THEN '-' ELSE url1 END,
             CASE WHEN NOT untitled2 THEN 'source-9=unknown=https://e.org/nine' END) AS sources FROM writes""",
)
def section_normalisation(spark, sf):
    rows = section_writes(spark, sf).withColumns(
        {
            "f": R.normalise_findings(F.col("key_findings")),
            "r": R.normalise_risks(F.col("risks")),
            "s": R.normalise_sources(F.col("sources")),
        }
    )
    return rows.select(
        "k",
        A.join(
            F.transform("f", lambda f: F.concat(f["finding_id"], F.lit("="), f["claim"], F.lit("<"), F.array_join(f["source_ids"], ",")))
        ).alias("findings"),
        A.join(
            F.transform("r", lambda r: F.concat(r["risk_id"], F.lit("="), r["description"], F.lit("/"), r["risk_type"], F.lit("/"), r["severity"]))
        ).alias("risks"),
        A.join(
            F.transform(
                "s", lambda s: F.concat(s["source_id"], F.lit("="), s["source_type"], F.lit("="), F.coalesce(s["url"], F.lit("-")))
            )
        ).alias("sources"),
    )


SAVED_SQL = "saved AS (SELECT * FROM writes WHERE section_id <> '' QUALIFY row_number() OVER (PARTITION BY project_id, section_id ORDER BY k DESC) = 1)"


def saved_sections(spark, sf):
    # The last writes are chosen before their texts are made, which are ten times as long as a part: the choice sorts all writes.
    p = F.col("p_partkey")
    keyed = table(spark, sf, "part").select(
        "*", F.col("p_brand").alias("project_id"), section_id_of(p).alias("section_id"), p.alias("seq")
    )
    return written(S.upsert_sections(keyed.where("section_id <> ''")))


def normal_sections(spark, sf):
    return R.normalise_section(saved_sections(spark, sf))


@query("section_store", "S9", f"WITH {WRITES_SQL}, {SAVED_SQL} SELECT project_id, section_id, k, title FROM saved")
def section_store(spark, sf):
    return saved_sections(spark, sf).select("project_id", "section_id", "k", "title")


@query(
    "saved_section_gate",
    "P19",
    f"""WITH {WRITES_SQL}, {SAVED_SQL}
        SELECT project_id, section_id, 'placeholder' AS reason FROM saved WHERE NOT no_findings AND contains(claim2, '待补充')
        UNION ALL SELECT project_id, section_id, 'findings_missing' FROM saved WHERE no_findings
        UNION ALL SELECT project_id, section_id, 'dangling_sources' FROM saved WHERE NOT no_findings AND untitled2
        UNION ALL SELECT project_id, section_id, 'source_without_url' FROM saved WHERE url1 = '' AND NOT internal1""",
)
def saved_section_gate(spark, sf):
    return rules.rejects(normal_sections(spark, sf), ["project_id", "section_id"], R.saved_section_rules())


@query(
    "source_store",
    "S9,X17",
    f"""WITH {WRITES_SQL}, s AS (SELECT project_id, k * 2 AS seq, url1 AS url, CASE WHEN internal1 THEN 'internal_knowledge_base' ELSE 'public_web' END AS kind, 't' AS title, cited1 AS source_id FROM writes
          UNION ALL SELECT project_id, k * 2 + 1, '', 'unknown', CASE WHEN untitled2 THEN '' ELSE 't' || (k % 3) END, 'source-9' FROM writes),
        y AS (SELECT *, CASE WHEN url <> '' THEN url WHEN title <> '' THEN kind || ':' || title END AS source_key FROM s)
        SELECT project_id, source_key, seq, source_id FROM y WHERE source_key IS NOT NULL QUALIFY row_number() OVER (PARTITION BY project_id, source_key ORDER BY seq DESC) = 1""",
)
def source_store(spark, sf):
    w = section_writes(spark, sf)
    first = w.select("project_id", (F.col("k") * 2).alias("seq"), F.col("sources")[0].alias("s")).select(
        "project_id", "seq", "s.url", "s.source_type", "s.title", "s.source_id"
    )
    second = w.select(
        "project_id",
        (F.col("k") * 2 + 1).alias("seq"),
        F.lit(None).cast("string").alias("url"),
        F.lit("unknown").alias("source_type"),
        F.when(F.col("k") % 8 == 0, F.lit("")).otherwise(F.concat(F.lit("t"), (F.col("k") % 3).cast("string"))).alias("title"),
        F.lit("source-9").alias("source_id"),
    )
    return S.upsert_sources(first.unionByName(second)).select("project_id", "source_key", "seq", "source_id")


@query(
    "report_source_union",
    "J6",
    f"""WITH {WRITES_SQL}, s AS (SELECT project_id, 0 AS side, k AS seq, CASE WHEN k % 3 = 0 THEN '' ELSE cited1 || '-' || (k % 50) END AS source_id, url1 AS url, 'p' AS title FROM writes
          UNION ALL SELECT project_id, 1, k, CASE WHEN k % 2 = 0 THEN cited1 || '-' || (k % 50) ELSE '' END, url1, 's' || (k % 5) FROM writes),
        y AS (SELECT *, CASE WHEN source_id <> '' THEN source_id WHEN url <> '' THEN url ELSE 'public_web:' || title END AS source_key FROM s)
        SELECT project_id, source_key, seq, title FROM y QUALIFY row_number() OVER (PARTITION BY project_id, source_key ORDER BY side DESC, seq DESC) = 1""",
)
def report_source_union(spark, sf):
    k = F.col("k")
    named = F.concat(F.lit("source-"), (k % 4).cast("string"), F.lit("-"), (k % 50).cast("string"))
    shape = lambda source_id, title: section_writes(spark, sf).select(
        "project_id",
        "seq",
        source_id.alias("source_id"),
        F.col("sources")[0]["url"].alias("url"),
        F.lit("public_web").alias("source_type"),
        title.alias("title"),
    )
    project = shape(F.when(k % 3 == 0, F.lit("")).otherwise(named), F.lit("p"))
    section = shape(F.when(k % 2 == 0, named).otherwise(F.lit("")), F.concat(F.lit("s"), (k % 5).cast("string")))
    return R.report_sources(project, section).select("project_id", "source_key", "seq", "title")


@query(
    "dangling_citations",
    "J5",
    f"WITH {WRITES_SQL}, {SAVED_SQL} SELECT project_id, section_id, 'source-9' AS source_id FROM saved WHERE NOT no_findings AND untitled2",
)
def dangling_citations(spark, sf):
    return R.dangling_citations(normal_sections(spark, sf))


@query(
    "missing_references",
    "J5",
    f"""WITH {WRITES_SQL}, {SAVED_SQL}, c AS (
          SELECT project_id, section_id, 0 AS i, cited1 AS source_id, claim1 AS title FROM saved WHERE NOT no_findings AND NOT uncited AND claim1 <> ''
          UNION ALL SELECT project_id, section_id, 1, 'source-9', claim2 FROM saved WHERE NOT no_findings),
        f AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY project_id, source_id ORDER BY section_id, i) = 1)
        SELECT project_id, source_id, title, replace(source_id, 'source-', '') AS sort_key FROM f WHERE source_id IN ('source-1', 'source-9')""",
)
def missing_references(spark, sf):
    sections = normal_sections(spark, sf)
    # Details are known for two of the ids only.
    known = sections.select("project_id", F.explode(F.array(F.lit("source-0"), F.lit("source-2"), F.lit("source-3"))).alias("source_id")).distinct()
    return R.missing_references(sections, known).withColumn(
        "sort_key", A.join(F.transform("sort_key", lambda x: x.cast("string")), ".")
    )


@query(
    "toc_parents",
    "J7",
    f"""WITH {WRITES_SQL}, {SAVED_SQL}, ids AS (SELECT DISTINCT project_id, section_id FROM saved),
        p AS (SELECT a.project_id, a.section_id, max_by(b.section_id, len(b.section_id)) AS parent_id FROM ids a LEFT JOIN ids b
               ON a.project_id = b.project_id AND starts_with(a.section_id, b.section_id || '.') GROUP BY ALL)
        SELECT project_id, section_id, coalesce(parent_id, '') AS parent_id,
          EXISTS (SELECT 1 FROM ids c WHERE c.project_id = p.project_id AND starts_with(c.section_id, p.section_id || '.')) AS is_parent,
          row_number() OVER (PARTITION BY project_id, coalesce(parent_id, '') ORDER BY list_transform(split(section_id, '.'), lambda x: x::BIGINT), section_id)::INT AS place FROM p""",
)
def toc_parents(spark, sf):
    ids = saved_sections(spark, sf).select("project_id", "section_id")
    return R.toc(ids).withColumn("parent_id", F.coalesce("parent_id", F.lit("")))


OUTLINES_SQL = """nodes AS (
  SELECT o_orderkey::VARCHAR AS project_id, u.node_id, u.parent_id, u.depth, u.is_leaf, u.ord FROM orders, LATERAL (
    SELECT '1' AS node_id, NULL AS parent_id, 1 AS depth, o_orderstatus = 'O' AS is_leaf, '0' AS ord
    UNION ALL SELECT '1.1', '1', 2, true, '00' WHERE o_orderstatus <> 'O'
    UNION ALL SELECT '1.2', '1', 2, false, '01' WHERE o_orderstatus <> 'O'
    UNION ALL SELECT '1.2.' || (o_custkey % 9), '1.2', 3, true, '010' WHERE o_orderstatus <> 'O'
    UNION ALL SELECT '2', NULL, 1, true, '1'
    UNION ALL SELECT '3', NULL, 1, true, '2' WHERE o_orderstatus = 'F'
    UNION ALL SELECT '4', NULL, 1, true, '3' WHERE o_orderstatus = 'F') u)"""


def outlines(spark, sf):
    """A nested outline per order, as JSON."""
    status = F.col("o_orderstatus")
    leaf = lambda name: F.concat(F.lit('{"node_id":"'), name, F.lit('","title":"t","children":[]}'))
    deep = F.concat(
        F.lit('{"node_id":"1.2","title":"t","children":['),
        leaf(F.concat(F.lit("1.2."), (F.col("o_custkey") % 9).cast("string"))),
        F.lit("]}"),
    )
    one = F.when(status == "O", leaf(F.lit("1"))).otherwise(
        F.concat(F.lit('{"node_id":"1","title":"t","children":['), leaf(F.lit("1.1")), F.lit(","), deep, F.lit("]}"))
    )
    rest = F.when(status == "F", F.concat(F.lit(","), leaf(F.lit("3")), F.lit(","), leaf(F.lit("4")))).otherwise(F.lit(""))
    outline = F.concat(F.lit("["), one, F.lit(","), leaf(F.lit("2")), rest, F.lit("]"))
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").cast("string").alias("project_id"), outline.alias("outline"), status.alias("status")
    )


def outline_rows(spark, sf):
    return R.outline_nodes(outlines(spark, sf), "project_id", "outline")


@query(
    "outline_flatten",
    "J8",
    f"WITH {OUTLINES_SQL} SELECT project_id, node_id, coalesce(parent_id, '') AS parent_id, depth, is_leaf, ord FROM nodes",
)
def outline_flatten(spark, sf):
    return outline_rows(spark, sf).select(
        "project_id",
        "node_id",
        F.coalesce("parent_id", F.lit("")).alias("parent_id"),
        "depth",
        "is_leaf",
        A.join(F.transform("path", lambda x: x.cast("string")), "").alias("ord"),
    )


@query(
    "missing_sections",
    "J4",
    f"""WITH {OUTLINES_SQL}, w AS (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY ord) AS place FROM nodes WHERE is_leaf),
        s AS (SELECT DISTINCT l_orderkey::VARCHAR AS project_id, CASE WHEN l_linenumber % 2 = 0 THEN '2' ELSE '1.1' END AS section_id FROM lineitem)
        SELECT project_id, node_id AS section_id FROM w WHERE place <= 4 AND NOT EXISTS (SELECT 1 FROM s WHERE s.project_id = w.project_id AND s.section_id = w.node_id)""",
)
def missing_sections(spark, sf):
    saved = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("project_id"),
        F.when(F.col("l_linenumber") % 2 == 0, F.lit("2")).otherwise(F.lit("1.1")).alias("section_id"),
    )
    return R.missing_sections(outline_rows(spark, sf), saved)


@query(
    "outline_membership",
    "J9",
    f"""WITH {OUTLINES_SQL}, s AS (SELECT l_orderkey::VARCHAR AS project_id, l_linenumber, (l_linenumber % 5)::VARCHAR AS section_id FROM lineitem)
        SELECT project_id, section_id, count(*) AS n FROM s WHERE EXISTS (SELECT 1 FROM nodes n WHERE n.project_id = s.project_id AND n.node_id = s.section_id) GROUP BY ALL""",
)
def outline_membership(spark, sf):
    sections = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("project_id"), (F.col("l_linenumber") % 5).cast("string").alias("section_id")
    )
    kept = R.in_outline(sections, outline_rows(spark, sf)).where("in_outline")
    return kept.groupBy("project_id", "section_id").agg(F.count("*").alias("n"))


@query(
    "node_description",
    "P24",
    """SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN ' d ' WHEN p_size % 3 = 1 THEN 'q ' || p_type ELSE p_name END AS description FROM part""",
)
def node_description(spark, sf):
    size = F.col("p_size") % 3
    description = F.when(size == 0, F.lit(" d ")).when(size == 1, F.lit("  "))
    question = F.when(size == 1, F.concat(F.lit(" q "), "p_type", F.lit(" "))).otherwise(F.lit(""))
    filled = Q.filled_description(description, question, F.concat("p_name", F.lit(" ")))
    return table(spark, sf, "part").select("p_partkey", filled.alias("description"))


@query(
    "section_synthesis",
    "A7",
    f"""WITH {WRITES_SQL}, {SAVED_SQL}, r AS (SELECT *, CASE WHEN k % 2 = 0 THEN 'about ' || p_type ELSE '' END AS summary,
           CASE WHEN no_findings THEN [] WHEN claim1 = '' THEN [claim2] ELSE [claim1, claim2] END AS claims FROM saved),
        x AS (SELECT project_id, section_id, 'c' AS kind, i, t FROM (SELECT project_id, section_id, unnest([summary] || claims) AS t, unnest(range(len(claims) + 1)) AS i FROM r)
          UNION ALL SELECT project_id, section_id, 'i', 0, title || ': ' || CASE WHEN summary <> '' THEN summary ELSE claims[1] END FROM r WHERE summary <> '' OR len(claims) > 0
          UNION ALL SELECT project_id, section_id, 'r', 0, risk1 FROM r),
        d AS (SELECT project_id, kind, trim(t) AS t, min((section_id, i)) AS spot FROM x WHERE trim(t) <> '' GROUP BY ALL),
        b AS (SELECT *, row_number() OVER (PARTITION BY project_id, kind ORDER BY spot) AS place FROM d)
        SELECT project_id, string_agg(t, '|' ORDER BY place) FILTER (WHERE kind = 'c' AND place <= 8) AS core_conclusions,
               string_agg(t, '|' ORDER BY place) FILTER (WHERE kind = 'i' AND place <= 8) AS cross_section_insights,
               string_agg(t, '|' ORDER BY place) FILTER (WHERE kind = 'r' AND place <= 8) AS global_risks,
               string_agg(t, '；' ORDER BY place) FILTER (WHERE kind = 'c' AND place <= 6) AS executive_summary FROM b GROUP BY project_id""",
)
def section_synthesis(spark, sf):
    out = R.synthesis(normal_sections(spark, sf))
    for name in ("core_conclusions", "cross_section_insights", "global_risks"):
        out = out.withColumn(name, A.join(F.col(name)))
    return out


@query(
    "report_documents",
    "P25,J7",
    f"""WITH {WRITES_SQL}, {SAVED_SQL}, pr AS (SELECT p_brand AS project_id, min(p_partkey) AS k FROM part GROUP BY p_brand),
        t AS (SELECT s.*, row_number() OVER (PARTITION BY project_id ORDER BY section_id)::INT AS ordinal, EXISTS (SELECT 1 FROM saved o WHERE o.project_id = s.project_id AND starts_with(o.section_id, s.section_id || '.')) AS is_overview FROM saved s)
        SELECT pr.project_id, CASE WHEN pr.k % 2 = 0 THEN '研究报告' ELSE 'R ' || pr.project_id END AS title, CASE WHEN pr.k % 3 = 0 THEN 'syn' ELSE 'exec' END AS executive_summary,
          string_agg(t.section_id || ':' || CASE WHEN t.title = '' THEN '章节 ' || ordinal ELSE t.title END || ':' || is_overview::VARCHAR || ':'
             || CASE WHEN no_findings THEN 0 WHEN claim1 = '' THEN 1 ELSE 2 END, '|' ORDER BY ordinal) AS sections
        FROM pr JOIN t USING (project_id) GROUP BY pr.project_id, pr.k""",
)
def report_documents(spark, sf):
    from evispark.operators.ranking import ranked

    p = F.col("k")
    projects = (
        table(spark, sf, "part")
        .groupBy(F.col("p_brand").alias("project_id"))
        .agg(F.min("p_partkey").alias("k"))
        .select(
            "project_id",
            F.when(p % 2 == 0, F.lit(" ")).otherwise(F.concat(F.lit("R  "), "project_id")).alias("title"),
            F.when(p % 3 == 0, F.lit("")).otherwise(F.lit("exec")).alias("executive_summary"),
            F.lit("syn").alias("synthesis_summary"),
            F.lit("").alias("body"),
        )
    )
    sections = ranked(saved_sections(spark, sf), ["project_id"], [F.asc("section_id")], "ordinal")
    sources = sections.select(
        "project_id",
        "ordinal",
        F.col("sources")[0]["source_id"].alias("source_id"),
        F.col("sources")[0]["title"].alias("title"),
        F.col("sources")[0]["url"].alias("url"),
        F.lit(None).cast("string").alias("published_at"),
        F.lit("").alias("source_type"),
    )
    docs = R.report_documents(projects, sections, sources)
    shown = F.transform(
        "sections",
        lambda s: F.concat_ws(
            ":", s["section_id"], s["title"], s["is_overview"].cast("string"), F.size(s["key_findings"]).cast("string")
        ),
    )
    return docs.select("project_id", "title", "executive_summary", A.join(shown).alias("sections"))


@query(
    "project_gate",
    "P22",
    """WITH r AS (SELECT o_orderkey AS request_id, o_custkey % 12 AS nk, CASE o_orderstatus WHEN 'O' THEN 'confirm' WHEN 'F' THEN 'report' ELSE 'render' END AS action FROM orders),
       p AS (SELECT n_nationkey AS nk, n_name AS project_id, CASE WHEN n_regionkey % 2 = 0 THEN 'outline_confirmed' ELSE 'created' END AS status, n_nationkey % 3 <> 0 AS has_outline, n_nationkey % 4 <> 0 AS has_sections FROM nation WHERE n_nationkey <> 7)
       SELECT request_id, 'NATION_' || r.nk AS project_id, CASE WHEN status IS NULL THEN 'unknown_project' WHEN action = 'confirm' THEN 'no_outline' WHEN action = 'report' THEN 'outline_not_confirmed' ELSE 'no_sections' END AS reason
       FROM r LEFT JOIN p ON p.nk = r.nk WHERE status IS NULL OR (action = 'confirm' AND NOT has_outline) OR (action = 'report' AND status <> 'outline_confirmed') OR (action = 'render' AND NOT has_sections)""",
)
def project_gate(spark, sf):
    status = F.col("o_orderstatus")
    requests = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("request_id"),
        F.concat(F.lit("NATION_"), (F.col("o_custkey") % 12).cast("string")).alias("project_id"),
        F.when(status == "O", F.lit("confirm")).when(status == "F", F.lit("report")).otherwise(F.lit("render")).alias("action"),
    )
    n = F.col("n_nationkey")
    projects = table(spark, sf, "nation").where(n != 7).select(
        F.col("n_name").alias("project_id"),
        F.when(F.col("n_regionkey") % 2 == 0, F.lit("outline_confirmed")).otherwise(F.lit("created")).alias("status"),
        (n % 3 != 0).alias("has_outline"),
        (n % 4 != 0).alias("has_sections"),
    )
    return S.gate(requests, projects)


@query(
    "report_versions",
    "S8",
    """WITH o AS (SELECT o_custkey AS project_id, o_orderkey, o_orderdate, o_orderstatus FROM orders),
       old AS (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY o_orderkey) AS version FROM o WHERE o_orderstatus = 'F')
       SELECT project_id, o_orderkey, (coalesce((SELECT max(version) FROM old WHERE old.project_id = o.project_id), 0)
              + row_number() OVER (PARTITION BY project_id ORDER BY o_orderdate, o_orderkey))::INT AS version FROM o WHERE o_orderstatus <> 'F'""",
)
def report_versions(spark, sf):
    from evispark.operators.ranking import ranked

    rows = table(spark, sf, "orders").select(F.col("o_custkey").alias("project_id"), "o_orderkey", "o_orderdate", "o_orderstatus")
    stored = ranked(rows.where("o_orderstatus = 'F'"), ["project_id"], [F.asc("o_orderkey")], "version")
    new = rows.where("o_orderstatus <> 'F'").drop("o_orderstatus")
    return S.with_versions(new, stored, [F.asc("o_orderdate"), F.asc("o_orderkey")]).drop("o_orderdate")


@query(
    "latest_reports",
    "S8",
    """SELECT o_custkey AS project_id, max(o_orderkey) AS version, max_by(o_orderpriority, o_orderkey) AS title FROM orders GROUP BY 1""",
)
def latest_reports(spark, sf):
    reports = table(spark, sf, "orders").select(
        F.col("o_custkey").alias("project_id"), F.col("o_orderkey").alias("version"), F.col("o_orderpriority").alias("title")
    )
    return S.latest_versions(reports)


@query(
    "most_recent_report",
    "S8",
    "SELECT o_custkey AS project_id, o_orderkey AS version FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 1",
)
def most_recent_report(spark, sf):
    reports = table(spark, sf, "orders").select(
        F.col("o_custkey").alias("project_id"), F.col("o_orderkey").alias("version"), F.col("o_orderdate").alias("created_at")
    )
    return S.most_recent(reports, F.desc("version")).drop("created_at")


@query(
    "keyed_project_read",
    "S17",
    """SELECT o_orderkey, c_custkey IS NOT NULL AS found, CASE WHEN c_custkey IS NULL THEN '' WHEN c_nationkey % 2 = 0 THEN c_mktsegment WHEN c_nationkey % 3 = 0 THEN c_name ELSE '' END AS outline
       FROM orders LEFT JOIN customer ON c_custkey = o_custkey * 2""",
)
def keyed_project_read(spark, sf):
    n = F.col("c_nationkey")
    none = F.array().cast("array<string>")
    projects = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("project_id"),
        F.when(n % 2 == 0, F.array("c_mktsegment")).otherwise(none).alias("confirmed"),
        F.when(n % 3 == 0, F.array("c_name")).otherwise(none).alias("draft"),
    )
    keys = table(spark, sf, "orders").select("o_orderkey", (F.col("o_custkey") * 2).alias("project_id"))
    read = S.keyed_read(projects, keys, "project_id")
    outline = S.confirmed_outline(F.col("confirmed"), F.col("draft"))
    return read.select("o_orderkey", "found", F.coalesce(A.join(outline), F.lit("")).alias("outline"))


