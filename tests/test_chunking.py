import pytest
from pyspark.sql import functions as F

from evispark.operators import chunking as K


def docs(spark, *texts):
    rows = [(f"{i:064x}", f"T{i}", t, "其他", ["不限"], ["a"], []) for i, t in enumerate(texts)]
    schema = (
        "document_id string, file_title string, md_content string, document_type string, "
        "region_names array<string>, topics array<string>, keywords array<string>"
    )
    return spark.createDataFrame(rows, schema)


def blocks(spark, text, **sizes):
    return K.document_blocks(docs(spark, text), **sizes).orderBy("block_index").collect()


MIXED = "# Guide\n\nSome text.\n\n表 1 数据\n\n| a | b |\n|---|---|\n| 1 | 2 |\n\n## Code\n\n```python\n# no heading\nx = 1\n```\n"


def test_text_table_and_code(spark):
    rows = blocks(spark, MIXED)
    assert {r.context_type for r in rows} == {"text", "table", "code"}
    table = next(r for r in rows if r.context_type == "table")
    assert table.section_title == "表 1 数据"
    assert table.content.startswith("表 1 数据\n| a | b |")
    code = next(r for r in rows if r.context_type == "code")
    assert code.content == "```python\n# no heading\nx = 1\n```"
    assert code.section_path == ["Guide", "Code"]


def test_long_text_is_cut_and_complete(spark):
    sentences = [f"第{i}句测试内容。" for i in range(200)]
    rows = blocks(spark, "# 标题\n\n" + "".join(sentences))
    assert len(rows) > 1
    assert all(len(r.content) <= 1000 for r in rows)
    whole = "".join(r.content for r in rows)
    assert all(s in whole for s in sentences)
    assert all(r.content.startswith("# 标题") for r in rows)


def test_neighbouring_pieces_share_their_edge(spark):
    text = " ".join(f"Sentence number {i} is here." for i in range(120))
    rows = blocks(spark, text)
    for a, b in zip(rows, rows[1:]):
        assert b.content.startswith(a.content[-30:].strip()[:20]) or a.content[-30:].strip() in b.content


def test_sentence_without_a_break_is_sliced(spark):
    rows = blocks(spark, "x" * 2500)
    assert all(len(r.content) <= 1000 for r in rows)
    assert sum(r.content.count("x") for r in rows) >= 2500


def test_skipped_levels_keep_the_path_by_position(spark):
    text = "# A\n\n" + "a" * 400 + "\n### C\n\n" + "c" * 400 + "\n### D\n\n" + "d" * 400 + "\n## B\n\n" + "b" * 400
    paths = [r.section_path for r in blocks(spark, text)]
    assert paths == [["A"], ["A", "C"], ["A", "C", "D"], ["A", "B"]]


def test_unclosed_fence_and_html_table_run_to_the_end(spark):
    rows = blocks(spark, "text\n\n~~~\n# a\n\nb")
    assert [(r.context_type, r.content) for r in rows] == [("text", "text"), ("code", "~~~\n# a\n\nb")]
    rows = blocks(spark, "text\n<TABLE><tr>\n# a\n```\nb")
    assert [r.context_type for r in rows] == ["text", "table"]


def test_longer_fence_needs_a_longer_close(spark):
    rows = blocks(spark, "````\na\n```\nb\n````\nafter")
    assert [(r.context_type, r.content) for r in rows] == [("code", "````\na\n```\nb\n````"), ("text", "after")]


def test_pipe_table_repeats_its_header_and_keeps_a_long_row(spark):
    long_row = "| " + "z" * 1200 + " | 1 |"
    body = "\n".join(f"| row {i} {'y' * 60} | {i} |" for i in range(40))
    rows = blocks(spark, "Table 2. big\n| h | n |\n| --- | :---: |\n" + body + "\n" + long_row)
    assert len(rows) > 3
    assert all(r.content.startswith("Table 2. big\n| h | n |\n| --- | :---: |\n") for r in rows)
    assert sum(long_row in r.content for r in rows) == 1
    whole = "\n".join(r.content for r in rows)
    assert all(f"| row {i} " in whole for i in range(40))
    assert all(len(r.content) <= 1000 for r in rows if long_row not in r.content)


def test_html_table_pieces_are_closed(spark):
    body = "".join(f"<tr><td>{i} {'q' * 50}</td></tr>" for i in range(60))
    rows = blocks(spark, f"<table border=1><tr><th>h</th></tr>{body}</table>")
    assert len(rows) > 2
    for r in rows:
        assert r.content.startswith("<table border=1><tr><th>h</th></tr>")
        assert r.content.endswith("</table>")
        assert len(r.content) <= 1000
    assert sum(r.content.count("<td>") for r in rows) == 60


def test_code_pieces_are_fenced(spark):
    lines = [f"line_{i} = {'v' * 40}" for i in range(60)]
    rows = blocks(spark, "```py\n" + "\n".join(lines) + "\n```")
    assert len(rows) > 2
    for r in rows:
        assert r.content.startswith("```py\n") and r.content.endswith("\n```") and len(r.content) <= 1000
    inner = [x for r in rows for x in r.content.split("\n")[1:-1]]
    assert inner == lines
    unclosed = blocks(spark, "~~~~ py\n" + "\n".join(lines))
    assert all(r.content.endswith("\n~~~~") for r in unclosed)


def test_short_siblings_join_below_one_top_heading(spark):
    rows = blocks(spark, "# A\n\none\n\n## B\n\ntwo\n\n# Z\n\nthree")
    assert [(r.section_title, r.section_path) for r in rows] == [("A；B", []), ("Z", ["Z"])]


def test_line_ends_and_byte_order_mark(spark):
    from evispark.sources.documents import load_markdown

    raw = docs(spark, "﻿# A\r\n\r\ntext\rmore").withColumn("path", F.lit("")).select("*")
    loaded = load_markdown(raw)
    assert loaded.first().md_content == "# A\n\ntext\nmore"


def test_chunks_have_stable_ids_and_contiguous_numbers(spark):
    import hashlib

    rows = K.chunk_documents(docs(spark, MIXED, "# B\n\n" + "word. " * 500)).collect()
    by_doc = {}
    for r in rows:
        by_doc.setdefault(r.document_id, []).append(r)
    for doc, chunks in by_doc.items():
        chunks.sort(key=lambda r: r.chunk_index)
        assert [c.chunk_index for c in chunks] == list(range(len(chunks)))
        for c in chunks:
            assert c.chunk_id == hashlib.sha256(f"{doc}|{c.chunk_index}".encode()).hexdigest()
            assert c.embedding_text.endswith(c.content) and c.embedding_text.startswith(c.file_title)


def test_sizes_are_checked(spark):
    with pytest.raises(ValueError):
        K.document_blocks(docs(spark, "x"), overlap=400)


def test_chunking_needs_no_shuffle_of_large_input(spark):
    many = docs(spark, *[MIXED] * 8).repartition(4)
    plan = K.chunk_documents(many)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") <= 1


def test_scan_keeps_every_state(spark):
    from evispark.functions import arrays as A

    sizes = [0, 1, 31, 32, 33, 1023, 1024, 1025, 3000]
    rows = spark.createDataFrame([(n, list(range(1, n + 1))) for n in sizes], "n int, v array<int>")
    sums = A.scan(F.filter("v", lambda x: x > 0), F.lit(0), lambda acc, x: acc + x)
    for r in rows.select("n", sums.alias("s")).collect():
        assert r.s == [k * (k + 1) // 2 for k in range(1, r.n + 1)]


def test_time_grows_with_the_headings(spark):
    import time

    def seconds(n):
        text = "\n\n".join(f"# h{i}\n\ntext of it that is. {'word ' * 30}" for i in range(n))
        df = docs(spark, text)
        assert K.document_blocks(df).count() == n  # compiles
        started = time.perf_counter()
        K.document_blocks(df).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - started

    seconds(500)
    assert seconds(12_000) < 4 * seconds(3_000) * 1.3 + 1


def test_pieces_agree_with_a_plain_walk(spark):
    """Greedy packing with the tail carried over, over random units and sizes."""
    import random

    rng = random.Random(4)
    for target, overlap in ((40, 5), (60, 0), (25, 24)):
        lists = [["x" * rng.randrange(1, 30) + rng.choice(["", " y"]) for _ in range(rng.randrange(0, 90))] for _ in range(20)]
        df = spark.createDataFrame([(i, u) for i, u in enumerate(lists)], "i int, u array<string>")
        for r in df.select("u", K.packed_text(F.col("u"), target, overlap).alias("p")).collect():
            want, current = [], ""
            for unit in r.u:
                longer = f"{current}\n\n{unit}" if current else unit
                if current and len(longer) > target:
                    want.append(current)
                    current = f"{current[-overlap:]}\n{unit}".strip() if overlap else unit
                else:
                    current = longer
            assert r.p == want + [current] * bool(current)


def test_strip_removes_what_python_strips_in_linear_time(spark):
    """A pattern for the end of a text is tried at every blank before it: hours for a long run of blanks inside."""
    import time

    from evispark.functions import text as T

    blanks = [chr(i) for i in range(0x10000) if not 0xD800 <= i < 0xE000 and chr(i).isspace()]
    assert sorted(T.SPACE_CHARS) == blanks
    texts = ["", " ", "a", None, "᠎a​"] + [f"{c}\n{c}a{c}b{c} {c}" for c in blanks]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.strip(F.col("t")).alias("s")).collect()
    assert all(r.s == (None if r.t is None else r.t.strip()) for r in rows)
    started = time.monotonic()
    long = spark.range(1).select(F.concat(F.lit("a"), F.repeat(F.lit(" "), 400_000), F.lit("b ")).alias("t"))
    assert long.select(F.length(T.strip(F.col("t")))).first()[0] == 400_002
    assert time.monotonic() - started < 15
