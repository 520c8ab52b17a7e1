"""Golden cases for the page-field rules (FIXTURES.md §2)."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from lexframe.functions.text import norm_date
from lexframe.operators import extract as X

BASE = "http://bulletin.example/base/"

NORM_PAGE = """<html><head><script>var s="<strong>Ley 1 X</strong>";</script></head><body>
<strong>Resoluci&oacute;n&nbsp;Conjunta <b>47/2025</b> DIRECCION   NACIONAL</strong>
<span class="vr_azul11">01-ENE-2024</span><h1> TITULO <i>X</i></h1><span class="destacado">SUM</span>
<p>Publicada en el Bolet&iacute;n Oficial del <a href="?page_id=216&x=1">02/01/2024</a> N&uacute;mero: 35327 P&aacute;gina: 12</p>
<p><strong>Resumen:</strong><br>APRUEBASE EL <b>REGLAMENTO</b> DE PRUEBA.</p>
<a href="anexos/1/norma.htm">Texto completo de la norma</a> <a href="http://a/b">Texto actualizado</a>
<a href="verVinculos.do?modo=1&id=1">Modifica a 3 normas</a> <a href="verVinculos.do?modo=2&id=1">modificada por 12</a>
<p><strong>Observaciones:</strong> obs aqui <br></p>
</body></html>"""


def pages(spark, *htmls):
    return spark.createDataFrame([(i, f"u{i}", h) for i, h in enumerate(htmls)], "page_id long, url string, html string")


def test_norm_page_all_fields(spark):
    row = X.extract_norms(pages(spark, NORM_PAGE), BASE).first().asDict()
    assert row["tipo_norma"] == "Resolución Conjunta"
    assert row["numero_norma"] == "47"
    assert row["organismo_origen"] == "DIRECCION NACIONAL"
    assert row["clase_norma"] == ""
    assert row["fecha_sancion"] == "2024-01-01"
    assert row["titulo_resumido"] == "TITULOX"
    assert row["titulo_sumario"] == "SUM"
    assert row["fecha_boletin"] == "2024-01-02"
    assert row["numero_boletin"] == "35327"
    assert row["pagina_boletin"] == "12"
    assert row["texto_resumido"] == "APRUEBASE ELREGLAMENTODE PRUEBA."
    assert row["texto_original"] == BASE + "anexos/1/norma.htm"
    assert row["texto_actualizado"] == "http://a/b"
    assert row["modifica_a"] == "3"
    assert row["modificada_por"] == "12"
    assert row["observaciones"] == "obs aqui"
    assert row["id_norma"] == "0"


@pytest.mark.parametrize("text,tipo,numero,organismo", [
    ("Disposición 47/2025 DIRECCION NACIONAL", "Disposición", "47", "DIRECCION NACIONAL"),
    ("Ley 26865 HONORABLE CONGRESO", "Ley", "26865", "HONORABLE CONGRESO"),
    ("Resolución Conjunta 47/2025 DIRECCION NACIONAL", "Resolución Conjunta", "47", "DIRECCION NACIONAL"),
    ("Acta", "", "S/N", ""),
])
def test_header(spark, text, tipo, numero, organismo):
    p = pages(spark, f"<strong>{text}</strong>")
    r = (X.extract_tipo(p).join(X.extract_numero(p), "page_id").join(X.extract_organismo(p), "page_id")
         .first())
    assert (r.tipo_norma, r.numero_norma, r.organismo_origen) == (tipo, numero, organismo)


def test_no_header_defaults(spark):
    r = X.extract_norms(pages(spark, "<p>nada</p>"), BASE).first()
    assert (r.tipo_norma, r.numero_norma, r.modifica_a, r.modificada_por) == ("", "S/N", "0", "0")


@pytest.mark.parametrize("text,expected", [
    ("02/01/2024", dt.date(2024, 1, 2)), ("1/2/2024", dt.date(2024, 2, 1)),
    ("01-ENE-2024", dt.date(2024, 1, 1)), ("01-ene-2024", dt.date(2024, 1, 1)),
    ("01-ENE-2024 x", dt.date(2024, 1, 1)), ("31/02/2024", None), ("31-FEB-2024", None),
    ("01-JAN-2024", None), ("", None), (" 15/10/2025 ", dt.date(2025, 10, 15)),
])
def test_norm_date(spark, text, expected):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(norm_date("t").alias("d")).first().d == expected


def test_unparsable_sanction_date_kept_raw(spark):
    r = X.extract_fecha_sancion(pages(spark, '<span class="vr_azul11">sin fecha</span>')).first()
    assert r.fecha_sancion == "sin fecha"


def test_listing_links_first_seen_order(spark):
    html = ('<a href="verNorma.do?id=5">a</a><a href="x/verNorma.do;j=1?id=3&amp;b=2">b</a>'
            '<a href="verNorma.do?id=5">again</a><a href="otra.do?id=9">no</a>')
    got = [(r.pos, r.norm_id) for r in X.extract_links(pages(spark, html)).orderBy("pos").collect()]
    assert got == [(0, 5), (1, 3)]


@pytest.mark.parametrize("html,status,n", [
    ('<a href="verNorma.do?id=1">x</a>', "found", 1),
    ("<p>No se encontraron normas</p>", "empty", 0),
    ("<p>Sin resultados</p>", "empty", 0),
    ("<p>algo raro</p>", "suspect", 0),
])
def test_classify_listing(spark, html, status, n):
    r = X.classify_listing(pages(spark, html)).first()
    assert (r.status, r.n_ids) == (status, n)


def test_daily_cap_keeps_page_order(spark):
    html = "".join(f'<a href="verNorma.do?id={i}">n</a>' for i in range(300, 0, -1))
    links = X.daily_cap(X.extract_links(pages(spark, html)), 200)
    rows = links.orderBy("pos").collect()
    assert len(rows) == 200 and rows[0].norm_id == 300 and rows[-1].norm_id == 101


def test_resumen_forms(spark):
    short = "<p><strong>Resumen:</strong> corto</p><p>Resumen: UN TEXTO SUFICIENTEMENTE LARGO</p>"
    plain = "<p>resumen: otro texto bastante largo</p>"
    none = "<p>Resumen: breve</p>"
    got = {r.page_id: r.texto_resumido for r in X.extract_resumen(pages(spark, short, plain, none)).collect()}
    assert got == {0: "UN TEXTO SUFICIENTEMENTE LARGO", 1: "otro texto bastante largo", 2: ""}


def test_observaciones_followed_by_tag_is_empty(spark):
    r = X.extract_observaciones(pages(spark, "<strong>Observaciones:</strong><br>texto")).first()
    assert r.observaciones == ""


def test_titles_need_h1(spark):
    got = {r.page_id: (r.titulo_resumido, r.titulo_sumario) for r in
           X.extract_titles(pages(spark, '<span class="destacado">S</span>', '<h1>T</h1><span class="x destacado">S</span>')).collect()}
    assert got == {0: ("", ""), 1: ("T", "S")}


def test_extraction_is_one_projection(spark):
    plan = X.extract_norms(pages(spark, NORM_PAGE), BASE)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


# ---------------------------------------------------------------- page rules, by hand
def one(df):
    return df.first()


def test_two_links_of_one_rule_give_the_first(spark):
    html = '<a href="verVinculos.do?modo=1&id=9">modifica 3</a> <a href="verVinculos.do?modo=1">7</a>'
    assert one(X.extract_modifications(pages(spark, html))).modifica_a == "3"
    html = '<a href="verVinculos.do?modo=2">5</a> <a href="x.htm?modo=1">8</a>'
    r = one(X.extract_modifications(pages(spark, html)))
    assert (r.modifica_a, r.modificada_por) == ("0", "5")


def test_summary_in_any_element(spark):
    cases = {
        "<div><strong>Resumen:</strong> un texto bastante largo</div><p>otro</p>": "un texto bastante largo",
        "<div>a<br><td><strong><b>Resumen:</b></strong>texto de la celda aquí</td>b</div>": "texto de la celda aquí",
        "<div><strong>Resumen:</strong> uno <div>anidado y largo</div> dos</div>tres": "unoanidado y largodos",
        "<p><strong>Resumen:</strong><br>texto sin cierre final": "texto sin cierre final",
        "<div><strong>Resumen:</strong> corto</div><p>Resumen: el largo de verdad</p>": "el largo de verdad",
        "<div><p>sin cierre</div><p>Resumen: el largo de verdad</p><p>Resumen: otro más largo</p>": "el largo de verdad",
    }
    for html, want in cases.items():
        assert one(X.extract_resumen(pages(spark, html))).texto_resumido == want, html


def test_nested_link_text(spark):
    html = ('<a href="no.htm">Texto <b>completo</b></a><a href="si.htm"><b>TEXTO COMPLETO de la norma</b></a>'
            '<a name="x"><i>Texto actualizado</i></a>')
    r = one(X.extract_text_links(pages(spark, html), BASE))
    assert (r.texto_original, r.texto_actualizado) == (BASE + "si.htm", "")


def test_entities_numeric_and_named(spark):
    r = one(X.extract_tipo(pages(spark, "<strong>Resoluci&#243;n 47/2025 X</strong>")))
    assert r.tipo_norma == "Resolución"
    r = one(X.extract_titles(pages(spark, "<h1>&ldquo;A&#8221; &sect; &#xF1; &nada; &amp;lt;</h1>")))
    assert r.titulo_resumido == "“A” § ñ &nada; &lt;"


def test_whole_class_names(spark):
    html = '<h1>t</h1><span class="no-destacado">mal</span><span class="x destacado">bien</span>'
    assert one(X.extract_titles(pages(spark, html))).titulo_sumario == "bien"
    html = '<span class="vr_azul11x">1/1/2024</span><span class="vr_azul11">2/1/2024</span>'
    assert one(X.extract_fecha_sancion(pages(spark, html))).fecha_sancion == "2024-01-02"


def test_an_id_too_long_is_no_id(spark):
    html = '<a href="verNorma.do?id=12345678901234567890">x</a><a href="verNorma.do?id=7">y</a>'
    assert [(r.pos, r.norm_id) for r in X.extract_links(pages(spark, html)).collect()] == [(0, 7)]
    assert one(X.classify_listing(pages(spark, html))).n_ids == 1


def test_bulletin_paragraph_is_a_sibling(spark):
    cases = {
        "<div><h1>t</h1><span>x<p>Número: 1</p></span><p>Número: 2 Página: 3</p></div>": ("2", "3"),
        "<div><h1>t</h1></div><p>Número: 2</p>": ("", ""),
        "<div><h1>t</h1><br><p>Número: 4 <b>Página: 5</b></div><p>Número: 9</p>": ("4", "5"),
    }
    for html, want in cases.items():
        r = one(X.extract_boletin(pages(spark, html)))
        assert (r.numero_boletin, r.pagina_boletin) == want, html
    html = '<h1>t</h1><p><a href="?page_id=216&amp;n=1">05-ENE-2024</a></p>'
    assert one(X.extract_boletin(pages(spark, html))).fecha_boletin == "2024-01-05"


def test_nested_observations_label(spark):
    r = one(X.extract_observaciones(pages(spark, "<strong><b>Observaciones:</b></strong> un texto<br>")))
    assert r.observaciones == "un texto"


def test_cap_flags_keep_every_id(spark):
    links = X.extract_links(pages(spark, "".join(f'<a href="verNorma.do?id={i}">n</a>' for i in range(5))))
    assert X.daily_cap(links).count() == 5
    assert [r.kept for r in X.cap_flags(links, 2).orderBy("pos").collect()] == [True, True, False, False, False]


def test_attributes_without_quotes(spark):
    html = "<ul><li><a href=verNorma.do?id=5>x</a><a title='a>b' HREF = verNorma.do?id=6 >y</a><a data-href=verNorma.do?id=9 href>z</a></ul>"
    assert [r.norm_id for r in X.extract_links(pages(spark, html)).orderBy("pos").collect()] == [5, 6]
    r = one(X.classify_listing(pages(spark, html)))
    assert (r.page_id, r.status, r.n_ids) == (0, "found", 2)
    r = one(X.extract_text_links(pages(spark, "<a href=x.htm>Texto completo</a><a class=b href='y.htm'>Texto actualizado</a>"), BASE))
    assert (r.texto_original, r.texto_actualizado) == (BASE + "x.htm", BASE + "y.htm")
    assert one(X.extract_fecha_sancion(pages(spark, "<span class=vr_azul11>2/1/2024</span>"))).fecha_sancion == "2024-01-02"
    r = one(X.extract_modifications(pages(spark, "<a href=verVinculos.do?modo=1>4</a><a href=verVinculos.do?modo=2&copy=1>5</a>")))
    assert (r.modifica_a, r.modificada_por) == ("4", "5")
    r = one(X.extract_boletin(pages(spark, "<h1>t</h1><p><a href=?page_id=216&n=1>05-ENE-2024</a></p>")))
    assert r.fecha_boletin == "2024-01-05"


def test_character_references_as_the_parser_reads_them(spark):
    r = one(X.extract_titles(pages(spark, "<h1>Art&#146;s &aacute n&period; &#x80;&#129; AT&T &order &Order; R&ntilde;</h1>")))
    assert r.titulo_resumido == "Art\u2019s \u00e1 n. \u20ac\x81 AT&T &order &Order; R\u00f1"
    r = one(X.extract_text_links(pages(spark, '<a href="x?a=1&copy=2&amp;b&#61;3">Texto completo</a>'), BASE))
    assert r.texto_original == BASE + "x?a=1&copy=2&b=3"


def test_a_label_with_nothing_around_it(spark):
    """The page is the parent; no page ends the job."""
    cases = {
        "<strong>Resumen:</strong> texto bastante largo": "texto bastante largo",
        "<!DOCTYPE html><?xml?><strong>Resumen:</strong> texto bastante largo": "texto bastante largo",
        "<div>x</div><strong>Resumen:</strong> texto bastante largo": "xResumen:texto bastante largo",
        "</p></div><strong>Resumen:</strong>": "", "": "", "<": "", "<strong>": "", "</": "", "a < b <c": "",
    }
    got = {r.page_id: r for r in X.extract_norms(pages(spark, *cases, None), BASE).withColumn("page_id", F.col("id_norma").cast("int")).collect()}
    for i, (html, want) in enumerate(cases.items()):
        assert got[i].texto_resumido == want, html
    assert got[len(cases)].numero_norma == "S/N"


def test_labels_at_any_depth(spark):
    tags = ["u", "i", "b", "em", "span", "font", "a"]
    inner = "".join(f"<{t} class=x>" for t in tags) + "Resumen:" + "".join(f"</{t}>" for t in reversed(tags))
    assert one(X.extract_resumen(pages(spark, f"<div><strong>{inner}</strong> un texto bastante largo</div>"))).texto_resumido == "un texto bastante largo"
    html = "<p>" + "<b></b><br> " * 9 + "<i>Re</i>sumen: un texto bastante largo</p>"
    assert one(X.extract_resumen(pages(spark, html))).texto_resumido == "un texto bastante largo"
    html = "<div><strong>Resumen: <i>a</i></strong> con dos hijos no es una etiqueta</div><p>Resumen: el largo de verdad</p>"
    assert one(X.extract_resumen(pages(spark, html))).texto_resumido == "el largo de verdad"


def test_elements_close_as_in_the_page_parser(spark):
    from lexframe.functions.html import with_elements
    html = "<p>a<b>c</i>d<br/>e<x/>f</p>g<td>h<p/>i"
    row = one(with_elements(pages(spark, html)))
    assert row.tags == ["page_", "p", "b", "/i", "br", "x", "/p", "td", "p"]
    assert row.depths == [1, 2, 3, 3, 3, 3, 1, 2, 2]
    assert row.texts == ["", "a", "c", "d", "e", "f", "g", "h", "i"]


def test_a_page_of_many_tags(spark):
    html = "<h1>t</h1>" + "<div><a href=verNorma.do?id=%d>x</a>" % 7 * 3000 + "<p>Resumen: el largo de verdad</p>"
    r = one(X.extract_norms(pages(spark, html), BASE))
    assert (r.titulo_resumido, r.texto_resumido) == ("t", "el largo de verdad")
