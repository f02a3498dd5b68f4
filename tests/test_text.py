from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from sparkloom.functions import chunking as K
from sparkloom.functions import classify as C
from sparkloom.functions import text as T
from sparkloom.operators import structure


def one(spark, column, **values):
    return spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items())).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    ("f", "text", "expected"),
    [
        (T.normalize, "﻿a b​c\x07d\te", "a bcd\te"),
        (T.dehyphenate, "pre-\nvent and co- \n  op", "prevent and coop"),
        (T.drop_page_numbers, "a\n 12 \n12345\nb", "a\n12345\nb"),
        (T.collapse_blank_lines, "a\n \n\n\nb\nc", "a\n\nb\nc"),
        (T.strip_lines, "  a \n\t b  \n", "a\nb"),
        (T.page_marker_base, "diabetesatlas.org | 42", "diabetesatlas.org"),
        (T.page_marker_base, "chapter – IV", "chapter"),
        (T.page_marker_base, "no marker", None),
        (T.sanitize, " a\x00  b\n c ", "a b c"),
        (T.core_score, "", 0.0),
        (T.core_score, "short", 0.1),
        (T.core_score, "12 345 678 901 234 567", 0.15),
        (T.core_score, "----------------------ab", 0.2),
        (T.core_score, "word " * 50, 1.0),
        (T.script_language, "مرحبا بالعالم", "ar"),
        (T.script_language, "hello مرحبا", "mixed"),
        (T.script_language, "123", "en"),
        (T.file_type, "a.b.PDF", "application/pdf"),
        (T.file_type, "noext", "text/plain"),
        (C.safety_level, "I feel CHEST PAIN", "emergency"),
        (C.safety_level, "What dose of it", "high_risk"),
        (C.safety_level, "هل أنا مصاب بالسكري", "diagnosis"),
        (C.safety_level, "hello", "informational"),
        (C.unsupported_type, "what is type 3 diabetes", True),
        (C.unsupported_type, "what is type 2 diabetes", False),
        (C.is_follow_up, "What about  insulin?", True),
        (C.is_follow_up, "what insulin", False),
    ],
)
def test_text_functions(spark, f, text, expected):
    got = one(spark, f(F.col("t")), t=text)
    assert got == pytest.approx(expected) if isinstance(expected, float) else got == expected


def test_routes(spark):
    route = lambda q, s="all": one(spark, C.route(F.col("q"), F.lit(s)), q=q)
    assert route("insulin dose and medication") == "treatment"
    assert route("what food and fruit to eat") == "nutrition"
    assert route("hello") == "all" and route("insulin", "prevention") == "prevention"


def test_clarification(spark):
    ask = lambda q, ctx=False: one(spark, C.needs_clarification(F.col("q"), F.lit(ctx)), q=q)
    assert ask("") and ask("Tell me more?") and not ask("tell me more", True) and not ask("insulin?") and ask("help")


def test_rewriting(spark):
    say = lambda q, last="", had=False: one(spark, C.rewrite(F.col("q"), F.lit(last), F.lit(had)), q=q)
    assert say("carbs?") == "carbs? in the context of diabetes management"
    assert say("what about  rice", "Can I eat bread? ", True) == "Can I eat bread?. what about rice"
    assert say("a long enough question stays") == "a long enough question stays"


def test_markdown_tables(spark):
    rows = F.array(F.array(F.lit("a  b"), F.lit("c|d")), F.array(F.lit(" "), F.lit("")), F.array(F.lit("e")))
    assert one(spark, T.table_to_markdown(rows)) == "| a b | c\\|d |\n| --- | --- |\n| e |  |"


def test_chunks_keep_their_size():
    text = " ".join(f"Sentence {i} has some words in it." for i in range(400))
    parts = K.split_text(text, 500, 0, 50)
    assert all(len(p) <= 500 for p in parts) and " ".join(parts).split() == text.split()
    lapped = K.split_text(text, 500, 80, 50)
    assert all(len(p) <= 500 for p in lapped) and len(lapped) >= len(parts)
    assert K.split_text("", 10, 0) == [] and K.split_text(" \n", 10, 0) == []
    assert [len(p) for p in K.split_text("x" * 75, 30, 0, 1)] == [30, 30, 15]
    with pytest.raises(ValueError):
        K.split_text("a", 10, 10)


def test_budgeted_chunks_hold_their_limit():
    text = " ".join(f"Sentence {i} has some words in it." for i in range(300)) + "\n\n" + "y" * 1300
    parts = K.split_budgeted(text, 500, 50, 20)
    assert all(len(p) <= 500 for p in parts)
    assert [len(p) for p in K.split_budgeted("x" * 75, 30, 0, 1)] == [30, 30, 15]
    assert K.split_budgeted("a. b. c", 100, 10) == ["a. b. c"] and K.split_budgeted(" ", 10, 1) == []


def test_paragraph_chunks():
    text = "\n\n".join(["one two."] * 4 + ["Long first. " * 10])
    parts = K.split_paragraphs(text, 40, 0)
    assert parts[0] == "\n\n".join(["one two."] * 4) and all(len(p) <= 45 for p in parts)
    assert K.split_paragraphs(text, 40, 5)[1].startswith("two.")


def test_kept_blocks_stay_whole():
    code = "```\n" + "x = 1\n\n" * 60 + "```"
    text = "intro words here. " * 20 + code + " outro words here." * 20
    assert any(code in p for p in K.split_text(text, 400, 0, 10))


def test_lossless_overlap():
    words = [f"w{i}" for i in range(600)]
    parts = K.split_text(" ".join(words), 200, 60, 10, lossy=False)
    assert set(" ".join(parts).split()) >= set(words)


def test_titles_fill_down(spark):
    rows = [("d", 0, "heading", "S1", ""), ("d", 1, "text", "", ""), ("d", 2, "heading", "", "sub"), ("d", 3, "text", "", ""), ("d", 4, "heading", "S2", ""), ("d", 5, "text", None, "own"), ("d", 6, "text", "", "")]
    frame = spark.createDataFrame([(a, b, 1, s, u, "x", k) for a, b, k, s, u in rows], "document_name string, elem_idx long, page_number int, section_title string, subsection_title string, content string, content_type string")
    got = [(r.section_title, r.subsection_title) for r in structure.fill_titles(frame).orderBy("elem_idx").collect()]
    assert got == [("S1", ""), ("S1", ""), ("", "sub"), ("S1", "sub"), ("S2", ""), ("S2", "own"), ("S2", "")]


def test_running_lines_go(spark):
    pages = [("d", i, f"HEADER LINE\nbody {i}\nA running footer text | {i}\nglued A running footer text | {i} end") for i in range(1, 7)]
    got = structure.drop_repeated_lines(spark.createDataFrame(pages, "document_name string, page_number int, text string")).orderBy("page_number").collect()
    assert [r.text for r in got] == [f"body {i}\nglued  end" for i in range(1, 7)]
    assert all((r.exact_removed, r.marker_removed) == (1, 2) for r in got)
    few = structure.drop_repeated_lines(spark.createDataFrame(pages[:2], "document_name string, page_number int, text string")).collect()
    assert {r.text for r in few} == {p[2] for p in pages[:2]}


def test_chunk_ids(spark):
    assert one(spark, T.chunk_id(F.lit("A file-name.v2.pdf"), F.lit(3), F.lit(7))) == "A_file_name_v2_p3_c7"


def test_hints_replace_the_question(spark):
    say = lambda q: one(spark, C.rewrite(F.col("q"), F.lit(""), F.lit(False)), q=q)
    assert say("How much was spent on care in 2024?") == "Over USD 1 trillion was spent on diabetes in 2024; 12% of global health expenditure"
    assert say("كم عدد البالغين في 2024 وفي 2050") == "589 million adults aged 20 79 living with diabetes in 2024; adults living with diabetes projected 853 million by 2050"


def test_evidence_must_name_the_condition(spark):
    meets = lambda q, e: one(spark, C.matches_directly(C.evidence_groups(F.col("q")), F.col("e")), q=q, e=e)
    assert meets("treatment of type 1", "Type 1 diabetes needs insulin") and not meets("treatment of type 1", "type 2 only")
    assert not meets("risk factors for type 2", "type 2 and risk factor") and meets("risk factors for type 2", "Risk factors for  type 2 diabetes are")
    assert meets("anything", "at all")


@pytest.mark.parametrize(
    ("text", "expected"),
    [("the cat and the dog are in the house of the king", "en"), ("le chat et la souris sont dans la maison pour une nuit", "fr"), ("der Hund und die Katze sind nicht auf dem Dach", "de"), ("el perro y los gatos en la casa con una flor para el rey", "es"), ("short", "en"), ("هذا هو السؤال عن العلاج في المنزل", "ar")],
)
def test_languages(spark, text, expected):
    assert one(spark, C.language(F.col("t")), t=text) == expected


def test_chunks_are_passed_on_in_parts(spark):
    """A task holds the chunks of a part of a batch (before: those of all its texts), and all are there, in order."""
    import pyarrow as pa

    texts = [("word " * 400 + str(i)) for i in range(3000)] + [None, "", " "]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["doc_id", "text"])
    parts = list(K._chunk_rows(K.split_budgeted, {"size": 500, "overlap": 50})([batch]))
    assert len(parts) > 4 and max(p.column("chunk").nbytes for p in parts) < 2 * K.HELD_CHARS
    got = [tuple(r.values()) for p in parts for r in p.to_pylist()]
    want = [(i, n, c) for i, t in enumerate(texts) for n, c in enumerate(K.split_budgeted(t, size=500, overlap=50))]
    assert got == want
    frame = spark.createDataFrame([("a", "one. " * 300), ("b", None)], "key string, body string")
    rows = K.chunk_documents(frame, "key", "body", size=400, overlap=40)
    assert rows.dtypes == [("key", "string"), ("pos", "int"), ("chunk", "string")]
    assert [(r.pos, r.chunk) for r in rows.collect()] == list(enumerate(K.split_text("one. " * 300, size=400, overlap=40)))


def test_folded_words_come_as_one_string(spark):
    """Python returns one string a text (before: a list of words, many times as large)."""
    frame = spark.createDataFrame([("Straße ﬁn, ok",), ("",), ("...",), (None,)], "text string")
    got = [r.w for r in frame.select(T.folded_tokens(F.col("text")).alias("w")).collect()]
    assert got == [["strasse", "fin", "ok"], [], [], None]
    plan = frame.select(T.folded_tokens(F.col("text")))._jdf.queryExecution().executedPlan().toString()
    assert "split(normalize_words(text" in plan or "split(pythonUDF0" in plan


def test_languages_agree_when_few_words_are_remembered(spark, sf, monkeypatch):
    """The table of scores starts anew within a text; its size is bounded by its cells, whatever the number of languages (before: by words alone)."""
    from sparkloom.operators import langid

    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang")
    model = langid.fit(docs)
    found = lambda: [(r.doc_id, r.language, r.probability and round(r.probability, 6)) for r in langid.identify(docs, model).orderBy("doc_id").collect()]
    many = found()
    monkeypatch.setattr(langid, "_MEMO_CELLS", 3 * (len(model.languages) + 1))
    assert found() == many and len(many) == docs.count()


def test_clean_pages_cleans_a_page_once(spark):
    """The plan of the statistics reads cleaned pages and their lines from tables; footers glued to other text go as before."""
    glued = [("d", p, f"Line {p} of its own\nAnnual report of the works | {p}\n{'tail ' * p}Annual report of the works | {p} and more") for p in range(1, 6)]
    pages = spark.createDataFrame(glued, "document_name string, page_number int, text string")
    kept, stats = structure.clean_pages(pages)
    assert [r.text for r in kept.orderBy("page_number").collect()] == [f"Line {p} of its own\n{'tail ' * p} and more" for p in range(1, 6)]
    row = stats.first()
    assert (row.pages_before, row.pages_after, row.repeated_boilerplate_lines_removed, row.footer_lines_removed) == (5, 5, 0, 10)
    assert "translate(" not in stats._jdf.queryExecution().optimizedPlan().toString()
