"""Research sections: normal form, rules, citations, outline, synthesis and report assembly."""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as t

from evispark.functions import text as T
from evispark.operators.ranking import first_per_key, ranked, top_k
from evispark.session import once

# Fixed values.
CONFIDENCE = ("high", "medium", "low")
RISK_TYPES = ("evidence_gap", "source_conflict", "stale_data", "uncertainty", "execution_risk")
INTERNAL_SOURCE = "internal_knowledge_base"
MIN_BODY_CHARS = 120
MAX_REPORT_SECTIONS = 4
NO_CONCLUSIONS = "本报告基于已确认大纲逐章节完成研究。"
DEFAULT_TITLE = "研究报告"
NO_BODY = "本章节尚未提供正文内容。"
FALLBACK_SECTION_TITLE = "研究内容"
FALLBACK_BODY = "当前研究结果未提供章节正文，无法渲染完整报告内容。"


def _ids(values: Column) -> Column:
    cleaned = F.transform(F.coalesce(values, F.array().cast("array<string>")), lambda x: T.first_text(x))
    return F.filter(cleaned, lambda x: x != "")


def _or_empty(values: Column, like: str) -> Column:
    return F.coalesce(values, F.array().cast(like))


def normalise_sources(sources: Column) -> Column:
    """Sources with a title; missing ids are numbered by position."""
    shaped = F.transform(
        sources,
        lambda s, i: F.struct(
            F.coalesce(
                T.blank_to_null(s["source_id"]),
                T.blank_to_null(s["id"]),
                F.concat(F.lit("source-"), (i + 1).cast("string")),
            ).alias("source_id"),
            T.first_text(s["title"]).alias("title"),
            T.blank_to_null(s["url"]).alias("url"),
            T.blank_to_null(s["published_at"]).alias("published_at"),
            F.coalesce(T.blank_to_null(s["source_type"]), F.lit("unknown")).alias("source_type"),
            T.blank_to_null(s["summary"]).alias("summary"),
        ),
    )
    return F.filter(shaped, lambda s: s["title"] != "")


def first_given(*cols: Column) -> Column:
    """First non-empty value, stripped afterwards: a blank value still counts as given."""
    return T.strip(F.coalesce(*[F.nullif(c, F.lit("")) for c in cols], F.lit("")))


def normalise_findings(findings: Column) -> Column:
    shaped = F.transform(
        findings,
        lambda f, i: F.struct(
            F.coalesce(T.blank_to_null(f["finding_id"]), F.concat(F.lit("finding-"), (i + 1).cast("string"))).alias(
                "finding_id"
            ),
            first_given(f["claim"], f["summary"], f["title"]).alias("claim"),
            _ids(f["source_ids"]).alias("source_ids"),
            T.choice(f["confidence"], CONFIDENCE, "medium").alias("confidence"),
        ),
    )
    return F.filter(shaped, lambda f: f["claim"] != "")


def normalise_risks(risks: Column) -> Column:
    shaped = F.transform(
        risks,
        lambda r, i: F.struct(
            F.coalesce(T.blank_to_null(r["risk_id"]), F.concat(F.lit("risk-"), (i + 1).cast("string"))).alias("risk_id"),
            first_given(r["description"], r["summary"], r["title"]).alias("description"),
            _ids(r["source_ids"]).alias("source_ids"),
            T.choice(r["risk_type"], RISK_TYPES, "uncertainty").alias("risk_type"),
            T.choice(r["severity"], CONFIDENCE, "medium").alias("severity"),
        ),
    )
    return F.filter(shaped, lambda r: r["description"] != "")


def normalise_section(sections: DataFrame) -> DataFrame:
    return sections.select(
        "project_id",
        T.first_text(F.col("section_id")).alias("section_id"),
        T.first_text(F.col("title")).alias("title"),
        T.blank_to_null(F.col("summary")).alias("summary"),
        T.first_text(F.col("body")).alias("body"),
        normalise_findings(F.col("key_findings")).alias("key_findings"),
        normalise_risks(F.col("risks")).alias("risks"),
        normalise_sources(F.col("sources")).alias("sources"),
    )


def _needs_url(s: Column) -> Column:
    return (T.first_text(s["source_type"]) != INTERNAL_SOURCE) & ~T.is_http_url(s["url"])


def cited_ids(findings: Column, risks: Column) -> Column:
    """Distinct source ids that findings and risks refer to."""
    none = F.array().cast("array<string>")
    of = lambda items: F.coalesce(F.flatten(F.transform(items, lambda x: _ids(x["source_ids"]))), none)
    return F.array_distinct(F.concat(of(findings), of(risks)))


def with_evidence(sections: DataFrame) -> DataFrame:
    """Add ``evidence``, the sources in normal form and the cited ids, which several of ``section_rules`` look at."""
    found = F.struct(
        normalise_sources(F.col("sources")).alias("sources"),
        cited_ids(F.col("key_findings"), F.col("risks")).alias("cited"),
    )
    return once(sections, "evidence", found)


def section_rules(in_outline: Column) -> list[tuple[str, Column]]:
    """Every rule a section must pass before it is saved; all broken ones are reported. On rows ``with_evidence``."""
    findings, risks = F.col("key_findings"), F.col("risks")
    body = T.first_text(F.col("body"))
    sources, cited = F.col("evidence.sources"), F.col("evidence.cited")
    known = F.coalesce(F.transform(sources, lambda s: s["source_id"]), F.array().cast("array<string>"))
    claim = lambda f: first_given(f["claim"], f["summary"], f["title"])
    told = lambda r: first_given(r["description"], r["summary"], r["title"])
    any_of = lambda items, test: F.coalesce(F.exists(items, test), F.lit(False))
    marked = lambda c: T.contains_any(c, T.SECTION_PLACEHOLDERS)
    return [
        ("section_id_empty", T.first_text(F.col("section_id")) == ""),
        ("section_not_in_outline", (T.first_text(F.col("section_id")) != "") & ~in_outline),
        ("title_empty", T.first_text(F.col("title")) == ""),
        ("body_too_short", F.length(body) < MIN_BODY_CHARS),
        ("body_placeholder", marked(body)),
        ("findings_missing", F.coalesce(F.size(findings), F.lit(0)) <= 0),
        ("claim_empty", any_of(findings, lambda f: claim(f) == "")),
        ("claim_placeholder", any_of(findings, lambda f: marked(claim(f)))),
        ("finding_without_sources", any_of(findings, lambda f: F.size(_ids(f["source_ids"])) == 0)),
        ("sources_missing", (F.size(cited) > 0) & (F.size(known) == 0)),
        ("dangling_sources", F.size(F.array_except(cited, known)) > 0),
        ("source_without_url", any_of(sources, _needs_url)),
        (
            "cited_source_without_url",
            F.coalesce(
                F.arrays_overlap(F.transform(F.filter(sources, _needs_url), lambda s: s["source_id"]), cited), F.lit(False)
            ),
        ),
        ("risk_description_empty", any_of(risks, lambda r: told(r) == "")),
        ("risk_placeholder", any_of(risks, lambda r: marked(told(r)))),
    ]


def saved_section_rules() -> list[tuple[str, Column]]:
    """The gate before rendering, on normalised sections."""
    findings, risks, sources = F.col("key_findings"), F.col("risks"), F.col("sources")
    whole = F.concat_ws(
        " ",
        F.col("body"),
        F.array_join(F.transform(findings, lambda f: f["claim"]), " "),
        F.array_join(F.transform(risks, lambda r: r["description"]), " "),
    )
    cited = cited_ids(findings, risks)
    known = F.transform(sources, lambda s: s["source_id"])
    return [
        ("placeholder", T.contains_any(whole, T.RENDER_PLACEHOLDERS)),
        ("body_empty", T.first_text(F.col("body")) == ""),
        ("findings_missing", F.size(findings) == 0),
        ("dangling_sources", F.size(F.array_except(cited, known)) > 0),
        ("source_without_url", F.exists(sources, _needs_url)),
    ]


def in_outline(sections: DataFrame, nodes: DataFrame) -> DataFrame:
    """Sections with a flag telling whether their id is a node of the project's outline."""
    known = nodes.select("project_id", F.col("node_id").alias("section_id"), F.lit(True).alias("in_outline")).distinct()
    return sections.join(known, ["project_id", "section_id"], "left").withColumn(
        "in_outline", F.coalesce("in_outline", F.lit(False))
    )


def dangling_citations(sections: DataFrame) -> DataFrame:
    """Cited source ids per section without a source of that id."""
    cited = sections.select(
        "project_id", "section_id", F.explode_outer(cited_ids(F.col("key_findings"), F.col("risks"))).alias("source_id")
    ).where("source_id IS NOT NULL")
    known = sections.select("project_id", "section_id", F.explode("sources").alias("s")).select(
        "project_id", "section_id", F.col("s.source_id").alias("source_id")
    )
    return cited.join(known, ["project_id", "section_id", "source_id"], "left_anti").distinct()


def missing_references(sections: DataFrame, sources: DataFrame) -> DataFrame:
    """Ids a report cites without any source of the project, in the order a reader expects.

    The title is that of the first finding, else risk, that cites the id.
    """
    cite = lambda items, told: F.flatten(
        F.transform(
            items,
            lambda x, i: F.transform(x["source_ids"], lambda s: F.struct(s.alias("source_id"), i.alias("i"), told(x).alias("title"))),
        )
    )
    found = sections.select(
        "project_id",
        "section_id",
        F.explode_outer(
            F.concat(
                F.transform(cite(F.col("key_findings"), lambda x: x["claim"]), lambda c: F.struct(F.lit(0).alias("kind"), c.alias("c"))),
                F.transform(cite(F.col("risks"), lambda x: x["description"]), lambda c: F.struct(F.lit(1).alias("kind"), c.alias("c"))),
            )
        ).alias("x"),
    ).where("x IS NOT NULL").select("project_id", "section_id", F.col("x.kind").alias("kind"), "x.c.*")
    first = first_per_key(found, ["project_id", "source_id"], [F.asc("section_id"), F.asc("kind"), F.asc("i")])
    missing = first.join(sources.select("project_id", "source_id"), ["project_id", "source_id"], "left_anti")
    return missing.withColumn("sort_key", reference_sort_key(F.col("source_id"))).select(
        "project_id", "source_id", "title", "sort_key"
    )


def reference_sort_key(source_id: Column) -> Column:
    """Numbers of an id such as ``source-3-12``; other parts sort last."""
    tail = F.regexp_replace(F.regexp_replace(source_id, "^source-", ""), "^source_search-", "")
    return F.transform(F.split(tail, "-", -1), lambda p: F.coalesce(p.try_cast("int"), F.lit(9999)))


def report_sources(project_sources: DataFrame, section_sources: DataFrame) -> DataFrame:
    """All sources of a project: the last one with the same id, else url, else type and title, stands.

    Both inputs: project_id, seq, source_id, url, source_type, title; section sources come after.
    """
    both = project_sources.withColumn("_side", F.lit(0)).unionByName(section_sources.withColumn("_side", F.lit(1)))
    key = F.coalesce(
        F.nullif("source_id", F.lit("")),
        F.nullif("url", F.lit("")),
        F.concat_ws(":", "source_type", "title"),
    )
    kept = [c for c in project_sources.columns if c != "project_id"]
    return (
        both.withColumn("source_key", key)
        .groupBy("project_id", "source_key")
        .agg(F.max_by(F.struct(*kept), F.struct("_side", "seq")).alias("s"))
        .select("project_id", "source_key", "s.*")
    )


OUTLINE_NODE = t.StructType(
    [
        t.StructField("node_id", t.StringType()),
        t.StructField("parent_id", t.StringType()),
        t.StructField("depth", t.IntegerType()),
        t.StructField("path", t.ArrayType(t.IntegerType())),
        t.StructField("is_leaf", t.BooleanType()),
    ]
)


def _nodes_of(outline: str | None) -> list[dict]:
    """Every node of one outline, parents before their children; a text that is no list of nodes has none."""
    try:
        top = json.loads(outline or "", parse_int=str, parse_float=str)
    except ValueError:
        return []
    out, waiting = [], [([], None, top if isinstance(top, list) else [])]
    while waiting:
        path, parent, level = waiting.pop()
        for place, node in enumerate(level):
            fields = node if isinstance(node, dict) else {}
            given, inner = fields.get("node_id"), fields.get("children")
            name = given if given is None or isinstance(given, str) else json.dumps(given)
            inner = inner if isinstance(inner, list) else []
            here = [*path, place]
            out.append({"node_id": name, "parent_id": parent, "depth": len(here), "path": here, "is_leaf": not inner})
            if inner:
                waiting.append((here, name, inner))
    return out


@F.arrow_udf(t.ArrayType(OUTLINE_NODE))
def _outline_tree(outlines: pa.Array) -> pa.Array:
    node = pa.struct([("node_id", pa.string()), ("parent_id", pa.string()), ("depth", pa.int32()), ("path", pa.list_(pa.int32())), ("is_leaf", pa.bool_())])
    return pa.array([_nodes_of(text) for text in outlines.to_pylist()], pa.list_(node))


def outline_nodes(outlines: DataFrame, key: str, outline_json: str) -> DataFrame:
    """All nodes of nested outlines of any depth: id, parent, depth, position path, leaf flag. One narrow step of the scan."""
    # An inner explosion would test the size of the tree first, and so walk it twice.
    nodes = outlines.select(F.col(key), F.explode_outer(_outline_tree(F.col(outline_json))).alias("n"))
    return nodes.where("n IS NOT NULL").select(key, "n.node_id", "n.parent_id", "n.depth", "n.path", "n.is_leaf")


def required_sections(nodes: DataFrame, limit: int | None = MAX_REPORT_SECTIONS) -> DataFrame:
    """Leaves in outline order, or all nodes of an outline without leaves; at most ``limit`` per project."""
    leaves = nodes.groupBy("project_id").agg(F.bool_or("is_leaf").alias("_any"))
    wanted = nodes.join(leaves, "project_id").where(F.col("is_leaf") | ~F.col("_any")).drop("_any")
    if limit is None:
        return wanted
    return top_k(wanted, ["project_id"], [F.asc("path"), F.asc("node_id")], limit, "place")


def missing_sections(nodes: DataFrame, saved: DataFrame, limit: int | None = MAX_REPORT_SECTIONS) -> DataFrame:
    needed = required_sections(nodes, limit).select("project_id", F.col("node_id").alias("section_id"))
    return needed.join(saved.select("project_id", "section_id"), ["project_id", "section_id"], "left_anti")


def with_parent(sections: DataFrame) -> DataFrame:
    """Nearest existing ancestor by dotted id, and whether a section has descendants.

    Every section offers all proper prefixes of its id; an equi-join keeps those that exist.
    """
    parts = F.split("section_id", r"\.")
    prefixes = sections.select(
        "project_id",
        "section_id",
        F.explode_outer(
            F.when(
                F.size(parts) > 1,
                F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), ".")),
            )
        ).alias("ancestor_id"),
    )
    existing = sections.select("project_id", F.col("section_id").alias("ancestor_id"))
    links = prefixes.join(existing, ["project_id", "ancestor_id"])
    nearest = links.groupBy("project_id", "section_id").agg(
        F.max_by("ancestor_id", F.length("ancestor_id")).alias("parent_id")
    )
    parents = links.select("project_id", F.col("ancestor_id").alias("section_id"), F.lit(True).alias("is_parent")).distinct()
    key = ["project_id", "section_id"]
    return (
        sections.join(nearest, key, "left")
        .join(parents, key, "left")
        .withColumn("is_parent", F.coalesce("is_parent", F.lit(False)))
    )


def toc_sort_key(section_id: Column) -> Column:
    """Dotted parts as numbers, other parts as 0."""
    return F.transform(
        F.split(section_id, r"\."), lambda p: F.when(F.rlike(p, F.lit(r"^\d+$")), p.try_cast("bigint")).otherwise(F.lit(0))
    )


def toc(sections: DataFrame) -> DataFrame:
    """Sections with parent and their place among the siblings."""
    linked = with_parent(sections).withColumn("_parent", F.coalesce("parent_id", F.lit("")))
    order = [F.asc(toc_sort_key(F.col("section_id"))), F.asc("section_id")]
    return ranked(linked, ["project_id", "_parent"], order, "place").drop("_parent")


def synthesis(sections: DataFrame, keep: int = 8, in_summary: int = 6) -> DataFrame:
    """Conclusions, insights and risks of a project's sections: first occurrences, first ``keep`` of each."""
    summary = F.coalesce(F.col("summary"), F.lit(""))
    claims = F.filter(F.transform("key_findings", lambda f: f["claim"]), lambda c: T.strip(c) != "")
    told = F.filter(F.transform("risks", lambda r: r["description"]), lambda c: T.strip(c) != "")
    insight = F.when(
        (summary != "") | (F.size(claims) > 0),
        F.concat("title", F.lit(": "), F.coalesce(F.nullif(summary, F.lit("")), F.get(claims, F.lit(0)))),
    )
    tagged = lambda kind, values: F.transform(values, lambda v, i: F.struct(F.lit(kind).alias("kind"), i.alias("i"), v.alias("text")))
    rows = sections.select(
        "project_id",
        "section_id",
        F.explode_outer(
            F.concat(
                tagged("conclusion", F.concat(F.array(summary), F.slice(claims, 1, 2))),
                tagged("insight", F.array(insight)),
                tagged("risk", F.slice(told, 1, 2)),
            )
        ).alias("x"),
    ).select("project_id", "section_id", "x.kind", "x.i", T.strip(F.coalesce("x.text", F.lit(""))).alias("text"))
    firsts = (
        rows.where("text <> ''")
        .groupBy("project_id", "kind", "text")
        .agg(F.min(F.struct("section_id", "i")).alias("at"))
    )
    best = top_k(firsts, ["project_id", "kind"], [F.asc("at")], keep, "place")
    lists = best.groupBy("project_id").agg(
        *[
            F.transform(
                F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.struct("place", "text")))), lambda x: x["text"]
            ).alias(name)
            for kind, name in (("conclusion", "core_conclusions"), ("insight", "cross_section_insights"), ("risk", "global_risks"))
        ]
    )
    joined = F.array_join(F.slice("core_conclusions", 1, in_summary), "；")
    full = sections.select("project_id").distinct().join(lists, "project_id", "left")
    none = F.array().cast("array<string>")
    for name in ("core_conclusions", "cross_section_insights", "global_risks"):
        full = full.withColumn(name, F.coalesce(name, none))
    return full.withColumn(
        "executive_summary", F.when(F.size("core_conclusions") > 0, joined).otherwise(F.lit(NO_CONCLUSIONS))
    )


def report_documents(projects: DataFrame, sections: DataFrame, sources: DataFrame) -> DataFrame:
    """One nested record per project.

    ``projects``: project_id, title, executive_summary, synthesis_summary, body. ``sections``: ordinal,
    section_id, title, summary, body, key_findings, risks. ``sources``: ordinal, source_id, title, url,
    published_at, source_type.
    """
    marked = with_parent(
        sections.withColumn("section_id", F.coalesce(F.nullif(T.collapse(F.col("section_id")), F.lit("")), F.col("ordinal").cast("string")))
    )
    shaped = marked.select(
        "project_id",
        F.struct(
            "ordinal",
            "section_id",
            F.coalesce(F.nullif(T.collapse(F.col("title")), F.lit("")), F.concat(F.lit("章节 "), F.col("ordinal").cast("string"))).alias("title"),
            F.nullif(T.collapse(F.col("summary")), F.lit("")).alias("summary"),
            F.coalesce(T.blank_to_null(F.col("body")), F.lit(NO_BODY)).alias("body"),
            normalise_findings(F.col("key_findings")).alias("key_findings"),
            normalise_risks(F.col("risks")).alias("risks"),
            F.col("is_parent").alias("is_overview"),
        ).alias("s"),
    )
    per_section = shaped.groupBy("project_id").agg(F.array_sort(F.collect_list("s")).alias("sections"))
    public = sources.select(
        "project_id",
        F.struct(
            "ordinal",
            F.coalesce(F.nullif(T.collapse(F.col("source_id")), F.lit("")), F.concat(F.lit("source-"), F.col("ordinal").cast("string"))).alias("source_id"),
            F.coalesce(F.nullif(T.collapse(F.col("title")), F.lit("")), F.concat(F.lit("来源 "), F.col("ordinal").cast("string"))).alias("title"),
            "url",
            "published_at",
            F.coalesce(F.nullif(T.collapse(F.col("source_type")), F.lit("")), F.lit("unknown")).alias("source_type"),
        ).alias("s"),
    )
    per_source = public.groupBy("project_id").agg(F.array_sort(F.collect_list("s")).alias("sources"))
    empty = lambda c: F.coalesce(F.nullif(T.collapse(c), F.lit("")))
    summary = F.coalesce(empty(F.col("executive_summary")), empty(F.col("synthesis_summary")))
    joined = projects.join(per_section, "project_id", "left").join(per_source, "project_id", "left")
    section_type = per_section.schema["sections"].dataType.simpleString()
    source_type = per_source.schema["sources"].dataType.simpleString()
    findings, risks = (F.array().cast(shaped.schema["s"].dataType[f].dataType) for f in ("key_findings", "risks"))
    fallback = F.array(
        F.struct(
            F.lit(1).alias("ordinal"),
            F.lit("summary").alias("section_id"),
            F.lit(FALLBACK_SECTION_TITLE).alias("title"),
            F.lit(None).cast("string").alias("summary"),
            F.coalesce(empty(F.col("body")), empty(F.col("executive_summary")), F.lit(FALLBACK_BODY)).alias("body"),
            findings.alias("key_findings"),
            risks.alias("risks"),
            F.lit(False).alias("is_overview"),
        )
    ).cast(section_type)
    return joined.select(
        "project_id",
        F.coalesce(empty(F.col("title")), F.lit(DEFAULT_TITLE)).alias("title"),
        summary.alias("executive_summary"),
        F.coalesce("sections", fallback).alias("sections"),
        F.coalesce("sources", F.array().cast(source_type)).alias("sources"),
    )


