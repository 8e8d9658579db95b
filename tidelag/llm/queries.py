"""The registered queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidelag.llm import (
    best_fit,
    compression_quality,
    feistel_pii,
    license_diagonals,
    line_quality,
    merkle_manifest,
    mil_toxicity,
    minmax_dedup,
    path_templates,
    secret_forest,
    spelling_variants,
    token_codec,
    winnowing,
)

Query = Callable[[SparkSession, str], DataFrame]

# Pseudonyms depend on this key alone; a real one comes from the caller's secret store.
PSEUDONYM_KEY = os.environ.get("PSEUDONYM_KEY", "example key")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_compression_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compression_quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_token_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_codec.coded(table(spark, sf_dir, "documents"), default_tokenizer())


def op3_secret_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return secret_forest.scan(documents, secret_forest.train_by_rule(documents))


def op4_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit.pack(best_fit.measured(table(spark, sf_dir, "documents")))


def op5_minmax_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minmax_dedup.dedup(table(spark, sf_dir, "documents"))


def op6_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = winnowing.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.drop("items")


def op7_line_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    field = line_quality.train(documents, table(spark, sf_dir, "labels"))
    return line_quality.judge_lines(documents, field)


def op8_feistel_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feistel_pii.pseudonymised(table(spark, sf_dir, "documents"), PSEUDONYM_KEY)


def op9_path_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return path_templates.judged_urls(table(spark, sf_dir, "pages"))


def op10_mil_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mil_toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_octopus_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle_manifest.manifest(table(spark, sf_dir, "documents"))


def op12_pivotal_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants.variants(table(spark, sf_dir, "documents"))


def op13_license_diagonals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_diagonals.licences(table(spark, sf_dir, "documents"))


def registered() -> dict[str, Query]:
    own = [
        op1_compression_quality,
        op2_token_codec,
        op3_secret_forest,
        op4_best_fit,
        op5_minmax_dedup,
        op6_winnowing,
        op7_line_crf,
        op8_feistel_pii,
        op9_path_templates,
        op10_mil_toxicity,
        op11_octopus_manifest,
        op12_pivotal_variants,
        op13_license_diagonals,
    ]
    return {f.__name__: f for f in own}


_SHINGLES = """
words as (
  select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') w from documents),
sets as (
  select doc_id, list_sort(list_distinct(case when len(w) = 0 then [] when len(w) < 4 then [array_to_string(w, ' ')]
    else list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) end)) s from words)"""

OP5_SQL = f"""
with recursive {_SHINGLES},
classes as (select s, min(doc_id) rep, len(s) n from sets where len(s) > 0 group by s),
grams as (select rep, n, unnest(s) g from classes),
met as (
  select a.rep a, b.rep b, any_value(a.n) na, any_value(b.n) nb, count(*) common
  from grams a join grams b on a.g = b.g and a.rep < b.rep and 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
  group by a.rep, b.rep),
links as (select a, b from met where 100 * common >= 80 * (na + nb - common)),
both_ways as (select a, b from links union all select b, a from links union all select rep, rep from classes),
reach(a, b) as (select a, b from both_ways union select r.a, e.b from reach r join both_ways e on r.b = e.a),
comp as (select a rep, min(b) component from reach group by a)
select d.doc_id, len(d.s)::bigint n_shingles, coalesce(comp.component, d.doc_id) component_id,
  d.doc_id = coalesce(comp.component, d.doc_id) kept
from sets d left join classes on classes.s = d.s left join comp on comp.rep = classes.rep
"""

_ALNUM = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

OP6_SQL = f"""
with dw as (select doc_id, {_ALNUM} w from documents),
bw as (select item_id::varchar item_id, {_ALNUM} w from benchmark),
bwin as (
  select distinct item_id, least(10, len(w)) n, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') g
  from (select item_id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) i from bw where len(w) > 0)),
sizes as (select distinct n from bwin),
dwin as (
  select doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') g
  from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) i from dw, sizes where len(w) >= n)),
hits as (select doc_id, i, d.n, item_id from dwin d join bwin b on d.g = b.g and d.n = b.n),
covered as (select doc_id, count(distinct p) n_hit from (select doc_id, unnest(range(i, i + n)) p from hits) group by doc_id),
items as (select doc_id, count(*) n_items, string_agg(item_id, ',' order by item_id) names
  from (select distinct doc_id, item_id from hits) group by doc_id)
select dw.doc_id, len(dw.w)::bigint n_words, coalesce(n_hit, 0)::bigint n_hit, coalesce(n_items, 0)::bigint n_items,
  sha256(coalesce(names, '')) items_sha256, coalesce(n_hit, 0) > 0 contaminated
from dw left join covered using (doc_id) left join items using (doc_id)
"""


_CRC_TABLE = """crc_steps(i, k, c) as (
  select i, 0, i::bigint from range(256) r(i)
  union all
  select i, k + 1, case when c % 2 = 1 then xor(c >> 1, 3988292384) else c >> 1 end from crc_steps where k < 8),
crc_table as (select list(c order by i) t from crc_steps where k = 8)"""


def _crc32(column: str) -> str:
    """SQL for the unsigned crc32 of a text's bytes, given ``t``, the table of 256 remainders."""
    digits = f"hex(encode({column}))"
    bytes_of = f"[('0x' || substr({digits}, 2 * i + 1, 2))::bigint for i in range(length({digits}) // 2)]"
    step = "lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1])"
    return f"xor(list_reduce({bytes_of}, {step}, 4294967295::bigint), 4294967295)"


def _op11_sql(levels: int = 12) -> str:
    """Trees of at most 8 ** levels leaves, one common table per level."""
    field = "coalesce(strlen({0}::varchar)::varchar || ':' || {0}::varchar, '-')".format
    low = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    leaf = lambda text: "sha256(" + " || ".join(map(field, ("doc_id", "source", "lang", "n_chars", text))) + ")"
    parts = [
        _CRC_TABLE,
        f"""leaves as (select doc_id, lang, {leaf('text')} leaf,
  case when {_crc32('doc_id::varchar')} % 3 = 0 then {leaf(low)} end other from documents, crc_table)""",
        "l0 as (select coalesce('1' || lang, '0') tree, row_number() over (partition by lang order by doc_id, leaf) - 1 place, "
        "leaf h, doc_id, leaf, coalesce(other, leaf) f, '' proof from leaves)",
    ]

    def climb(name: str) -> None:
        """``name``1 to ``name``12: rows carry their node's place and digest h, the tampered one f, and the proof."""
        for k in range(levels):
            parts.append(
                f"""{name}n{k} as (select tree, place, any_value(h) h from {name}{k} group by tree, place),
{name}r{k} as (select tree, place // 8 above, string_agg(h, '' order by place) run,
  list(h order by place) hs, max(place) last from {name}n{k} group by tree, place // 8),
{name}w{k} as (select tree, count(*) width from {name}n{k} group by tree),
{name}{k + 1} as (select x.tree, case when width > 1 then place // 8 else place end place,
  case when width > 1 then sha256(run) else h end h, doc_id, leaf,
  case when width > 1 then sha256(array_to_string(hs[:place % 8], '') || f || array_to_string(hs[place % 8 + 2:], '')) else f end f,
  case when width > 1 then proof || array_to_string(hs[:place % 8], '') || array_to_string(hs[place % 8 + 2:], '') else proof end proof
  from {name}{k} x join {name}r{k} r on x.tree = r.tree and x.place // 8 = r.above join {name}w{k} w on x.tree = w.tree)"""
            )

    climb("l")
    parts.append(
        f"t0 as (select '' tree, dense_rank() over (order by tree) - 1 place, h, doc_id, leaf, f, proof, h subroot from l{levels})"
    )
    mark = len(parts)
    climb("t")
    parts[mark:] = [p.replace("doc_id, leaf,", "doc_id, leaf, subroot,") for p in parts[mark:]]
    return (
        "with recursive " + ",\n".join(parts) + f"\nselect doc_id, leaf, subroot, h root, sha256(proof) proof_sha256, "
        f"f folded_root, f = h verified from t{levels}"
    )


OP12_SQL = f"""
with recursive {_CRC_TABLE},
runs as (select doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
  'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\u00C0-\u00FF]+')) run from documents),
counted as (select doc_id, run, count(*) n from runs where length(run) >= 6 group by all),
hashed as (select run, n, {_crc32("doc_id::varchar || ':' || run")} h from counted, crc_table),
altered as (select n, case when h % 199 = 0 then substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2)
  else run end word from hashed),
words as (select word, sum(n)::bigint n from altered where length(word) >= 6 group by word having sum(n) >= 5),
cut as (select word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) rest
  from (select *, unnest(range(1, length(word) + 1)) i from words)),
near as (
  select distinct a.word, b.word other, b.n from cut a join cut b on a.rest = b.rest and a.i = b.i and a.word <> b.word
  union select a.word, b.word, b.n from cut a join words b on a.rest = b.word
  union select b.word, a.word, a.n from cut a join words b on a.rest = b.word),
best as (select word, count(*) n_near, arg_min(other, (-n, other)) other, max(n) most from near group by word),
formed as (select words.word, words.n, coalesce(n_near, 0) n_near, case when most >= 5 * words.n then other end form,
  case when most >= 5 * words.n then most end form_n from words left join best using (word)),
chain(word, place, steps) as (
  select word, word, 0 from formed
  union all select c.word, f.form, steps + 1 from chain c join formed f on c.place = f.word where f.form is not null),
ends as (select word, arg_max(place, steps) root from chain group by word)
select word, form, root, n, n_near, form_n from formed join ends using (word)
"""


def _quoted(rows: list[tuple[str, ...]]) -> str:
    return ", ".join("(" + ", ".join("'" + v.replace("'", "''") + "'" for v in row) + ")" for row in rows)


_PHRASES = _quoted(list(license_diagonals.PHRASES.items()))
_NOTICES = _quoted(license_diagonals.NOTICES)
_STANDS = "list_filter(range(0, len(w)), lambda i: w[i + 1:i + len(p)] = p)"

OP13_SQL = f"""
with docs as (select doc_id, {_ALNUM} w from documents),
phrases as (select string_split(phrase, ' ') p, label from (values {_PHRASES}) x(phrase, label)),
places as (select doc_id, label, unnest({_STANDS}) place from docs, phrases
  where contains(array_to_string(w, ' '), array_to_string(p, ' '))),
base as (select doc_id, count(*) n_base, min(place) first_word, max(place) last_word, list(distinct label) base from places group by doc_id),
templates as (select label, text, {_ALNUM} t from (values {_NOTICES}) x(label, text)),
t_grams as (select label, text, t, place, array_to_string(t[place + 1:place + 3], ' ') g
  from (select *, unnest(range(0, len(t) - 2)) place from templates)),
d_grams as (select doc_id, w, place, array_to_string(w[place + 1:place + 3], ' ') g
  from (select *, unnest(range(0, len(w) - 2)) place from docs where len(w) >= 3)),
diagonals as (select doc_id, label, text, any_value(t) t, any_value(w) w, d.place - x.place diagonal
  from d_grams d join t_grams x using (g) group by doc_id, label, text, d.place - x.place),
agreeing as (select *, list_filter(range(0, len(t)), lambda j: diagonal + j >= 0 and t[j + 1] = w[diagonal + j + 1]) agree from diagonals),
steps as (select *, case when diagonal - lag(diagonal) over (partition by doc_id, label, text order by diagonal) > 3 then 1 else 0 end step
  from agreeing),
merged as (select *, sum(step) over (partition by doc_id, label, text order by diagonal) span from steps),
spans as (select doc_id, label, len(list_distinct(flatten(list(agree)))) agreed, any_value(len(t)) size
  from merged group by doc_id, label, text, span),
own as (select doc_id, coalesce(list(distinct label) filter (where 5 * agreed >= 4 * size), []) own, max(agreed / size) score
  from spans group by doc_id)
select doc_id, len(w)::bigint n_words, coalesce(n_base, 0)::bigint n_base, first_word::bigint first_word, last_word::bigint last_word,
  array_to_string(list_sort(coalesce(base, [])), ',') base_labels,
  array_to_string(list_sort(list_distinct(coalesce(base, []) || coalesce(own, []))), ',') labels, coalesce(score, 0.0)::double score
from docs left join base using (doc_id) left join own using (doc_id)
"""


def sql_texts() -> dict[str, str]:
    """SQL of the queries without a fitted model, a keyed cipher or a tokenizer."""
    return {
        "op5_minmax_dedup": OP5_SQL,
        "op6_winnowing": OP6_SQL,
        "op11_octopus_manifest": _op11_sql(),
        "op12_pivotal_variants": OP12_SQL,
        "op13_license_diagonals": OP13_SQL,
    }
