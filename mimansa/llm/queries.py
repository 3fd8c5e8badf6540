"""Queries of the training-data operators, with the SQL that states each result where SQL can."""

from __future__ import annotations

from mimansa.llm import boilerplate, canonical, duplicates, language, leakage, personal, repeated_lines, tokens
from mimansa.plans.support import read, spread

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


_EXACT = ", ".join(duplicates.EXACT)
_GROUPED = f"""
with s as (
  select row_id, {_EXACT},
    lower(regexp_replace(coalesce(brand_name, ''), '[^\\p{{L}}\\p{{Nd}}]+', '', 'g')) as b,
    lower(regexp_replace(coalesce(manufacturer, ''), '[^\\p{{L}}\\p{{Nd}}]+', '', 'g')) as m
  from medicines),
g as (
  select row_id, min(row_id) over w as first_id, count(*) over w as copies from s
  window w as (partition by least(b, m), greatest(b, m), {_EXACT}))
"""


@query("p2_found", _GROUPED + "select first_id as row_id_first, row_id as row_id_copy from g where row_id <> first_id")
def p2_found(spark, d):
    return duplicates.retyped_rows(spread(read(spark, d, "medicines")))


@query("p2_records", _GROUPED + "select row_id, copies from g where row_id = first_id")
def p2_records(spark, d):
    return duplicates.collapsed(spread(read(spark, d, "medicines")), "row_id", duplicates.EITHER, duplicates.EXACT).select("row_id", "copies")


_LINES = """
with l as (
  select doc_id, domain, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as line_no
  from zone_docs where text is not null),
k as (
  select doc_id, domain, cast(line_no as integer) as line_no,
    trim(regexp_replace(regexp_replace(lower(line), '\\p{Nd}+', '', 'g'), '[\\s\\x{A0}\\x{2000}-\\x{200A}\\x{202F}\\x{3000}\\x{85}\\x{1C}-\\x{1F}\\x{0B}]+', ' ', 'g')) as key
  from l),
c as (select domain, key from k where key <> '' group by all having count(distinct doc_id) >= 5)
"""


@query("p5_found", _LINES + "select distinct k.doc_id, k.line_no from k join c on c.key = k.key and c.domain is not distinct from k.domain")
def p5_found(spark, d):
    return repeated_lines.found(spread(read(spark, d, "zone_docs")))


_WORDS = r"trim(regexp_replace(lower(regexp_replace(regexp_replace(text, '[\p{Cf}\p{Mn}­͏️]+', '', 'g'), '</?[A-Za-z][^<>\n]{0,80}>|&(?:nbsp|zwnj|shy|#\d{1,6});', ' ', 'g')), '[^\p{L}\p{Nd}]+', ' ', 'g'))"
_PASSAGES = f"""
with dw as (select doc_id, row_number() over () as r, string_split({_WORDS}, ' ') as ws from documents where text is not null),
iw as (select item_id, string_split({_WORDS}, ' ') as ws from eval_items where text is not null),
dp as (select doc_id, r, unnest(range(1, len(ws) - 10)) as a, ws from dw where len(ws) >= 12),
ip as (select item_id, unnest(range(1, len(ws) - 10)) as b, ws from iw where len(ws) >= 12),
ds as (select doc_id, r, a, array_to_string(list_slice(ws, a, a + 11), ' ') as w from dp),
ws as (select item_id, b, array_to_string(list_slice(ws, b, b + 11), ' ') as w from ip),
hit as (select doc_id, r, item_id, a, b from ds join ws using (w))
"""


@query("p9_found", _PASSAGES + "select distinct doc_id, item_id from hit")
def p9_found(spark, d):
    return leakage.found(spread(read(spark, d, "documents")), read(spark, d, "eval_items"))


_FOLD = r"trim(regexp_replace(trim(regexp_replace(lower({0}), '[^\p{{L}}\p{{M}}\p{{N}}/]+', ' ', 'g')), ' ?/ |/ ?$|^ ?/', ' ', 'g'))"
_ALIASES = ", ".join(f"('{f}', '{a}')" for f, names in canonical.ALIASES.items() for a in names.split("|"))
_FORMS = f"""
with v as (
  select 'medicines' as src, row_id as ref_id, dosage_form as v from medicines union all select 'medicine_records', record_id, form from medicine_records),
r as (select * from v where v is not null and trim(regexp_replace(v, '[\\s\\p{{Z}}]+', ' ', 'g')) <> '' and v not in (select form from dosage_forms)),
t as (select src, ref_id, {_FOLD.format("v")} as typed from r),
refs as (
  select ref, min(form_id) as form_id from (
    select form_id, {_FOLD.format("form")} as ref from dosage_forms
    union all select form_id, {_FOLD.format("alias")} from dosage_forms join (values {_ALIASES}) a(form, alias) using (form)) where ref <> '' group by ref),
k as (select *, case when length(ref) <= 3 then 0 when length(ref) <= 8 then 1 when length(ref) <= 11 then 3 else 4 end as k from refs),
d as (select typed, ref, form_id, k, levenshtein(typed, ref) as distance from (select distinct typed from t), k where abs(length(typed) - length(ref)) <= k),
b as (select typed, min((distance, -length(ref), form_id)) as best from d where distance <= k group by typed)
"""


@query("p4_found", _FORMS + "select src, ref_id, coalesce(best[3], 0) as form_id from t left join b using (typed)")
def p4_found(spark, d):
    return canonical.found(spread(read(spark, d, "medicines")), spread(read(spark, d, "medicine_records")), read(spark, d, "dosage_forms"))


SURROGATE_KEY = "mimansa-demo-key"


@query("p10_found")
def p10_found(spark, d):
    return personal.found(spread(read(spark, d, "documents")))


@query("p10_redacted")
def p10_redacted(spark, d):
    return personal.redacted(spread(read(spark, d, "documents")), spark.conf.get("mimansa.surrogate.key", SURROGATE_KEY))


@query("p6_found")
def p6_found(spark, d):
    return language.found(spread(read(spark, d, "zone_docs")), read(spark, d, "lang_labels"))


@query("p7_found")
def p7_found(spark, d):
    return boilerplate.found(spread(read(spark, d, "stored_pages")), spread(read(spark, d, "zone_docs")))


@query("p8_ids")
def p8_ids(spark, d):
    return tokens.encoded(spread(read(spark, d, "documents")))


@query("p8_decoded", "select doc_id, coalesce(text, '') as text from documents")
def p8_decoded(spark, d):
    # what the ids say again: the round trip of every text
    return tokens.decoded(tokens.encoded(spread(read(spark, d, "documents"))))


@query("p5_cleaned", """
with z as (select *, row_number() over () as rid from zone_docs),
l as (select rid, doc_id, domain, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as line_no from z where text is not null),
""" + _LINES[_LINES.index("k as ("):].replace("select doc_id, domain,", "select rid, line, doc_id, domain,", 1) + """,
m as (select k.*, c.key is not null as gone from k left join c on c.key = k.key and c.domain is not distinct from k.domain),
o as (select rid, bool_or(gone) as hit, string_agg(line, chr(10) order by line_no) filter (where not gone) as rest from m group by rid)
select doc_id, crawled_at, case when hit then coalesce(rest, '') else text end as text from z left join o using (rid)""")
def p5_cleaned(spark, d):
    return repeated_lines.cleaned(spread(read(spark, d, "zone_docs")))


@query("p6_languages")
def p6_languages(spark, d):
    docs = spread(read(spark, d, "zone_docs"))
    return language.detect(docs, language.trained(docs, read(spark, d, "lang_labels")))


@query("p7_main")
def p7_main(spark, d):
    return boilerplate.main_text(spread(read(spark, d, "stored_pages")), spread(read(spark, d, "zone_docs")))


@query("p9_spans", _PASSAGES + """, run as (select *, a - row_number() over (partition by r, item_id, a - b order by a) as run from hit)
select doc_id, item_id, cast(min(a) - 1 as integer) as start_word, cast(min(b) - 1 as integer) as item_word, cast(count(*) + 11 as integer) as n_words from run group by r, doc_id, item_id, a - b, run""")
def p9_spans(spark, d):
    return leakage.leaks(spread(read(spark, d, "documents")), read(spark, d, "eval_items"))
