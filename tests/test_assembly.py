"""Numbers of pages, and the way from pages to documents."""

from pyspark.sql import functions as F

from foliospark.functions import values as V
from foliospark.operators import assembly as X
from foliospark.operators import markdown as M
from foliospark.operators import numbering as N


def test_numbers_over_blocks(spark):
    rows = [("a", k) for k in range(500)] + [("b", k % 7) for k in range(40)] + [(None, 3), (None, None), ("b", None)]
    d = spark.createDataFrame(rows, "file string, page int").repartition(5)
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "13")
        got = N.numbered(d, "file", ["page"]).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert len(got) == len(rows)
    for f in ("a", "b", None):
        own = sorted((r for r in got if r.file == f), key=lambda r: r.page_no)
        assert [r.page_no for r in own] == list(range(1, len(own) + 1)) and {r.total for r in own} == {len(own)}
        assert [r.page is not None for r in own] == sorted(r.page is not None for r in own)
        pages = [r.page for r in own if r.page is not None]
        assert pages == sorted(pages)
    assert N.numbered(d.limit(0), "file", ["page"]).count() == 0


LONG = "um texto nativo de folha com palavras bastantes"


def made(spark, rows):
    return spark.createDataFrame([("f", k + 1, len(rows), *r) for k, r in enumerate(rows)], "file string, page_no int, total int, text string, scan boolean, ink long, regions int, large_image boolean")


def words(spark, rows):
    return spark.createDataFrame([("f", p, region, k, w, str(conf)) for p, region, text, conf in rows for k, w in enumerate(text.split(" "))], "file string, page_no int, region int, word_ix int, text string, conf string")


def run(spark, pages, said, tables=(), policy="auto"):
    p = made(spark, pages)
    t = spark.createDataFrame(list(tables), "file string, page_no int, zone int, markdown string")
    return {r.page_no: r for r in X.sections(p, X.page_info(X.decided(p, policy), words(spark, said), "file"), t, "file", policy).collect()}


def test_what_is_read_goes_where_the_decision_says(spark):
    pages = [(LONG, False, 100, 1, False), (LONG, True, 10**6, 0, False), ("" * 40, False, 10, 0, False), ("curto", False, 10, 0, True), (None, False, 0, 0, False), (LONG, False, 100, 0, False)]
    said = [(1, 0, "recibo da compra", 55), (1, 1, "palavras bastantes folha", 90), (2, 0, "corpo escaneado inteiro", 90), (3, -1, "texto lido de novo agora", 80), (3, 0, "fora", 90), (4, -1, "mais letras da folha", 80), (6, 0, "sem pedido", 99)]
    got = run(spark, pages, said, [("f", 1, 2, "| b |"), ("f", 1, 1, "| a |")])
    assert [got[k].decision for k in range(1, 7)] == ["regioes:1", "regioes:1", "pagina", "pagina", "pagina", "pular"]
    one = got[1].section.split("\n")
    assert one[:5] == ["## Página 1 de 6", "", "_[texto nativo]_", "", LONG] and one[5:9] == ["", "| a |", "", "| b |"]
    assert one[9:] == ["", "> **[Texto extraído de imagem na página 1]**", "> recibo da compra", V.LOW_NOTE]
    assert got[2].text == LONG + "\ncorpo escaneado inteiro" and ">" not in got[2].section  # a layer, not a quote
    assert got[3].text == "texto lido de novo agora" and got[3]["class"] == V.CORRUPT
    assert got[4].text == "curto\nmais letras da folha" and V.HAND_BANNER in got[4].section
    assert got[5].text == "" and V.NO_TEXT in got[5].section and got[6].text == LONG
    never = run(spark, pages, said, policy="nunca")
    assert never[2].decision == "pular" and never[2].text == LONG
    again = run(spark, pages, [(2, -1, "lida de novo por inteiro", 90)], policy="sempre")
    assert again[2].text == "lida de novo por inteiro"


def test_parts_keep_the_numbers_of_the_file(spark):
    p = made(spark, [(f"Autos 09.2023.0000100{k}-4 {LONG}", False, 100, 0, False) for k in range(5)])
    d = X.sections(p, X.page_info(X.decided(p), words(spark, []), "file"), spark.createDataFrame([], "file string, page_no int, zone int, markdown string"), "file")
    placed = spark.createDataFrame([("f", k, 1 if k < 4 else 2) for k in range(1, 6)], "file string, page_no int, part_no int")
    one, two = X.documents(d, placed, "file").orderBy("part_no").collect()
    assert (one.first_page, one.n_pages, two.first_page, two.n_pages) == (1, 3, 4, 2)
    assert one.markdown.startswith("# f\n\n**Processo:** 09.2023.00001000-4 · **Total de páginas:** 5\n\n## Página 1 de 5\n")
    assert two.markdown.startswith("# f\n\n**Processo:** 09.2023.00001003-4 · ") and "## Página 5 de 5" in two.markdown and two.markdown.endswith("\n") and "## Página 3" not in two.markdown


def test_the_body_leaves_out_what_is_quoted(spark):
    d = spark.createDataFrame([("corpo da folha com texto bastante\nprimeiro  bloco\nsegundo\n[Pagina 1 de 2]", [("primeiro bloco", 90.0), ("segundo", 90.0)])], "t string, b array<struct<text:string,conf:double>>")
    body = M.body(F.col("t"), F.lit("[Pagina 1 de 2]"), F.lit(True), F.lit(False), F.col("b"))
    assert d.select(body.alias("x")).first().x == "corpo da folha com texto bastante"


def test_sections_of_repeated_and_null_ids(spark):
    from foliospark.plans import registry

    rows = [(1, LONG, "de", "s", 10), (1, LONG + " dois", "de", "s", 10), (None, LONG, "de", "s", 10), (2, None, "de", None, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    held, registry.docs = registry.docs, lambda *_: docs
    try:
        got = registry.md_sections(spark, "").collect()
    finally:
        registry.docs = held
    assert len(got) == 4 and sorted(r.section.split("\n")[0] for r in got) == ["## Página 1 de 1", "## Página 1 de 3", "## Página 2 de 3", "## Página 3 de 3"]
