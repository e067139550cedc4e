"""Queries from pages to Markdown files; registered with the others."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import values as V
from ..operators import assembly as X
from ..operators import numbering as N
from . import measured as Z
from .registry import _BAD, _HEADING, _LONG, _SOLID, _STRIP, _USABLE, _decision_sql, c, docs, query

#: Documents as pages: broken fonts, empty pages, case numbers, headings, scans, thin layers, images.
_TEXT = f"case when doc_id % 13 = 0 then '' when doc_id % 6 = 2 then concat('Autos 09.2023.0000', cast(3000 + doc_id % 7000 as string), '-4', chr(10), '11ª  Promotoria de Justiça', chr(10), {_BAD}) when doc_id % 10 = 3 then concat('DESPACHO', chr(10), {_BAD}, chr(10), chr(10), 'OFÍCIO  Nº 7', chr(10), 'PORTARIA') else {_BAD} end"
_PAGE = f"source, doc_id, {_TEXT} as text, doc_id % 3 = 0 as scan, n_chars * case when doc_id % 2 = 0 then 10 else 40 end as ink, case when doc_id % 4 = 1 then 2 else 0 end as regions, doc_id % 26 = 0 as large_image"
#: Recognised words of pages; runs on both engines but for the names of their functions.
_LISTS = [
    ("-1", "doc_id % 7 = 0 or doc_id % 13 = 0 or doc_id % 5 = 0", "concat('Texto lido da folha ', cast(doc_id as string), ' com mais de vinte letras')", "case when word_ix = 2 then '30' else '90' end"),
    ("0", "doc_id % 4 = 1 or doc_id % 3 = 0", "concat('Recibo numero ', cast(doc_id as string), '  pago')", "cast(50 + doc_id % 45 as string)"),
    ("1", "doc_id % 4 = 1", "{first}", "'95'"),
    ("2", "doc_id % 8 = 1", "'rabisco ilegivel'", "'x'"),
]
_TABLE = "concat('| Folha | ', cast(page_no as string), ' |', chr(10), '| --- | --- |', chr(10), '| zona | ', cast(zone as string), ' |')"


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    # chr of Spark knows bytes only
    d = spark.sql(f"select {_PAGE} from {{d}}".replace("chr(57344)", "'\ue000'"), d=docs(spark, sf_dir))
    return N.numbered(d, "source", ["doc_id"])


def _words(pages: DataFrame) -> DataFrame:
    first = "array_join(slice(split(translate(text, chr(10), ' '), ' '), 1, 12), ' ')"
    rows = [pages.where(where).select("source", "page_no", "doc_id", F.lit(int(region)).alias("region"), F.posexplode(F.split(F.expr(said.format(first=first)), " ")).alias("word_ix", "text")).selectExpr("source", "page_no", "region", "word_ix", "text", f"{conf} as conf") for region, where, said, conf in _LISTS]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


def _tables(pages: DataFrame) -> DataFrame:
    t = pages.where("page_no % 10 = 2").select("source", "page_no", F.explode(F.array(F.lit(2), F.lit(1))).alias("zone"))
    return t.selectExpr("source", "page_no", "zone", f"{_TABLE} as markdown")


def _done(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _pages(spark, sf_dir)
    return X.sections(p, X.page_info(X.decided(p), _words(p), "source"), _tables(p), "source")


_W = " union all ".join(
    f"select source, page_no, {region} as region, word_ix, x[word_ix + 1] as text, {conf} as conf from (select *, unnest(range(0, len(x))) as word_ix from (select *, string_split({said.format(first="array_to_string(string_split(replace(text, chr(10), ' '), ' ')[1:12], ' ')")}, ' ') as x from pg where {where}))"
    for region, where, said, conf in _LISTS
)
_SECTIONS = f"""pg as (select *, cast(row_number() over (partition by source order by doc_id) as int) as page_no, cast(count(*) over (partition by source) as int) as total from (select {_PAGE} from documents)),
kl as (select *, case when not {_USABLE.format('text')} then case when length({_STRIP.format('text')}) >= 20 then '{V.CORRUPT}' else '{V.IMAGE_ONLY}' end when scan then '{V.HYBRID}' else '{V.NATIVE}' end as class, case when ink <= 0 then 'inf' :: double else length({_SOLID.format('text')}) / ink * 1000.0 end as density from pg),
de as (select * exclude (n), n as regions, {_decision_sql('decision', "coalesce({some}, case when deficient then 'regioes:1' end, 'pular')")} from (select *  exclude (regions), regions as n, class = '{V.HYBRID}' and density < 45.0 as deficient from kl)),
wd as ({_W}),
bl as (select source, page_no, region, string_agg(t, ' ' order by word_ix) as said, avg(conf) as conf from (select * replace (coalesce(try_cast(conf as double), -1) as conf), {_STRIP.format('text')} as t from wd) where t <> '' and conf >= 40 group by all),
ok as (select b.*, de.decision, de.deficient and de.regions = 0 as scans, case when decision = 'pagina' then region = -1 else decision like 'regioes%' and region <> -1 and not (len({_LONG.format('said')}) > 0 and len(list_intersect({_LONG.format('said')}, {_LONG.format('text')})) / len({_LONG.format('said')}) >= 0.8) end as kept from bl b join de using (source, page_no)),
rd as (select source, page_no, string_agg(said, chr(10) order by region) as said from ok where kept and (decision = 'pagina' or scans) group by all),
qu as (select source, page_no, string_agg(concat(chr(10), '> **[Texto extraído de imagem na página ', page_no, ']**', chr(10), '> ', said, case when conf < 60 then concat(chr(10), '{V.LOW_NOTE}') else '' end), chr(10) order by region) as quotes from ok where kept and decision <> 'pagina' and not scans group by all),
fi as (select de.* exclude (text), coalesce(quotes, '') as quotes, length({_STRIP.format('de.text')}) < 40 and large_image as hand, concat_ws(chr(10), nullif(case when decision = 'pagina' and class in ('{V.CORRUPT}', '{V.HYBRID}') then '' else {_STRIP.format('de.text')} end, ''), rd.said) as text from de left join rd using (source, page_no) left join qu using (source, page_no)),
ln as (select source, page_no, i, line, {_HEADING.format('line')} as heading from (select source, page_no, unnest(string_split({_STRIP.format('text')}, chr(10))) as line, unnest(range(1, len(string_split({_STRIP.format('text')}, chr(10))) + 1)) as i from fi)),
mk as (select source, page_no, string_agg(case when heading is null then line else concat(case when i > 1 and ph is null and trim(pl) <> '' then chr(10) else '' end, '---', chr(10), chr(10), '### ', heading, chr(10)) end, chr(10) order by i) as marked from (select *, lag(line) over (partition by source, page_no order by i) as pl, lag(heading) over (partition by source, page_no order by i) as ph from ln) group by all),
tb as (select source, page_no, string_agg(concat(chr(10), chr(10), {_TABLE}), '' order by zone) as tables from (select source, page_no, unnest([1, 2]) as zone from pg where page_no % 10 = 2) group by all),
se as (select fi.*, concat('## Página ', page_no, ' de ', total, chr(10), chr(10), '_[', case when class = '{V.NATIVE}' then '{V.ORIGINS["native"]}' when class = '{V.HYBRID}' and not deficient then '{V.ORIGINS["reused"]}' else '{V.ORIGINS["ocr"]}' end, ']_', chr(10), chr(10), case when hand then concat('{V.HAND_BANNER}', chr(10), chr(10)) else '' end,
  case when (text = '' and quotes = '') or (text <> '' and not {_USABLE.format('text')} and quotes = '' and not hand) then '{V.NO_TEXT}' else marked end, coalesce(tables, ''), case when quotes = '' then '' else concat(chr(10), quotes) end) as section
  from fi join mk using (source, page_no) left join tb using (source, page_no))"""


@query(f"with {_SECTIONS} select source, page_no, total, class, decision, text, section from se")
def assembled_sections(spark, sf_dir):
    return _done(spark, sf_dir)


_SE = Z._FOLD + f", {_SECTIONS}, "


@query(_SE + """jo as (select se.*, f.part_no, row_number() over (partition by se.source, f.part_no order by page_no) as rn from se join f on f.source = se.source and f.k = se.page_no),
dm as (select source, part_no, any_value(total) as total, min(page_no) as first_page, count(*) as n_pages, string_agg(section, chr(10) || chr(10) order by page_no) as body, string_agg(text, chr(10) order by page_no) filter (rn <= 2) as t from jo group by source, part_no)
select source, cast(part_no as int) as part_no, first_page, cast(n_pages as int) as n_pages, concat('# ', source, chr(10), chr(10), concat_ws(' · ', '**Processo:** ' || nullif(regexp_extract(t, '\\b\\d{2}\\.\\d{4}\\.\\d{8}-\\d\\b'), ''),
  '**Unidade:** ' || nullif(trim(regexp_replace(regexp_extract(t, '(?im)^[^\\n]{0,80}(?:promotoria|procuradoria)[^\\n]{0,80}$'), '\\s+', ' ', 'g')), ''), '**Total de páginas:** ' || total), chr(10), chr(10), body, chr(10)) as markdown from dm""")
def assembled_documents(spark, sf_dir):
    return X.documents(_done(spark, sf_dir), Z._placed(spark, sf_dir).select("source", "page_no", "part_no"), "source")
