"""The operators' queries, each over its whole table, and their SQL where DuckDB can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import codes, embed_dedup, html_main, langid, media, mixing, packing, quality, resampling, sharding, simhash, tokens, toxicity
from ._base import table


def op1_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return media.media_digest(media.text_media(docs))


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op3_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.near_vectors(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return toxicity.score_documents(docs, toxicity.fit_on(docs, table(spark, sf_dir, "labels")))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_rows(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_main.extract_main_text(table(spark, sf_dir, "pages"))


def op9_temperature_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_documents(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return langid.identify(docs, langid.fit_on(docs))


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return resampling.resample(docs, table(spark, sf_dir, "benchmark").select("text"))


def op12_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.encode_vectors(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_media_columns, op2_simhash_near_dedup, op3_embedding_near_dedup, op4_toxicity, op5_token_counts,
        op6_sharding, op7_best_fit_packing, op8_html_extraction, op9_temperature_mixing, op10_language_id,
        op11_importance_resampling, op12_quality_rules, op13_vector_codes, pipeline,
    )
}



def _codes_sql() -> str:
    """Lloyd's rounds with every distance measured, one pair of expressions a round."""
    distance = "list_sum(list_transform(list_zip(x.v, y.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"

    def assigned(r: int, books: str) -> str:
        return f"a{r} as materialized (select x.vec_id, x.p, min({{'d': {distance}, 'c': y.c}}) as best from parts x join {books} y on x.p = y.p group by all)"

    def updated(r: int) -> str:
        return f"""means{r} as (
  select p, c, list(floor(s / n)::bigint order by k) as v from (
    select a.p, a.best.c as c, k, sum(x.v[k]) as s, count(*) as n from a{r} a join parts x on a.vec_id = x.vec_id and a.p = x.p cross join ks group by all) group by all),
b{r + 1} as materialized (select b.p, b.c, coalesce(m.v, b.v) as v from b{r} b left join means{r} m on b.p = m.p and b.c = m.c)"""

    rounds = ",\n".join(f"{assigned(r, f'b{r}')},\n{updated(r)}" for r in range(codes.ROUNDS))
    return f"""
with kept as (
  select vec_id, label, list_transform(embedding, lambda x: floor({codes.SCALE} * x::double)::bigint) as q from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
widths as (select (max(len(q)) // {codes.PARTS})::bigint as w from kept),
ks as (select unnest(range(1, w + 1)) as k from widths),
parts as materialized (select vec_id, p, q[p * w + 1 : p * w + w] as v from kept, widths, range({codes.PARTS}) t(p)),
b0 as materialized (
  select p, row_number() over (partition by p order by vec_id) - 1 as c, v from parts where vec_id in (select vec_id from kept order by vec_id limit {codes.ENTRIES})),
{rounds},
{assigned(codes.ROUNDS, f"b{codes.ROUNDS}")},
digest as (select sha256(string_agg(array_to_string(v, ','), ',' order by p, c)) as d from b{codes.ROUNDS}),
coded as (select vec_id, string_agg(printf('%02x', best.c), '' order by p) as code, sum(best.d)::bigint as error from a{codes.ROUNDS} group by 1)
select vec_id, code, error, (sum(error) over (partition by label))::bigint as label_error, d as codebooks_sha256 from coded join kept using (vec_id) cross join digest"""


def _quality_sql() -> str:
    """The same figures, votes and steps, over lists of patterns."""
    n = len(quality.RULES)
    each = " || ".join(f"case when n_words = 0 then '0' when {r.bad} then '-' when {r.good} then '+' else '0' end" for r in quality.RULES)
    js = f"range(1, {n + 1})"

    def posterior(votes: str) -> str:
        good = f"list_product(list_transform({js}, lambda j: case {votes}[j] when '+' then on_good[j] when '-' then 1 - on_good[j] else 1 end))"
        bad = f"list_product(list_transform({js}, lambda j: case {votes}[j] when '-' then on_bad[j] when '+' then 1 - on_bad[j] else 1 end))"
        return f"(prior * {good} / (prior * {good} + (1 - prior) * {bad}))"

    def learnt(right: str, chance: str, first: float, within: tuple[float, float]) -> str:
        hit = f"list_sum(list_transform(q, lambda x: if(x.votes[j] = '{right}', x.n * {chance}, 0)))"
        of = f"list_sum(list_transform(q, lambda x: if(x.votes[j] = '0', 0, x.n * {chance})))"
        return f"list_transform({js}, lambda j: least(greatest(if({of} > 0, {hit} / {of}, {first}), {within[0]}), {within[1]})::double)"

    word = r"[^\x20\x09-\x0D]"
    return f"""
with recursive texts as (
  select doc_id, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '{word}+') as w, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '{word}')) as l from documents),
windows as (select doc_id, i, array_to_string(w[i : i + 2], ' ') as s from (select doc_id, w, unnest(range(1, len(w) - 1)) as i from texts)),
again as (select doc_id, i from (select *, count(*) over (partition by doc_id, s) as n from windows) where n > 1),
covered as (select doc_id, count(distinct j) as n from (select doc_id, unnest([i, i + 1, i + 2]) as j from again) group by 1),
measured as (
  select x.doc_id, len(w)::bigint as n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::bigint as word_chars,
    (length(t) - length(translate(t, '#*$%&|<>', '')))::bigint as n_symbols, len(l) as n_lines, (len(l) - len(list_distinct(l)))::bigint as n_dup_lines, coalesce(n, 0)::bigint as n_repeat_words,
    length(t) - length(translate(t, '.!?', '')) as n_stops, length(regexp_replace(t, '\\P{{Lu}}+', '', 'g')) as n_capitals
  from texts x left join covered c on x.doc_id = c.doc_id),
voted as (select *, {each} as votes, n_words < {quality.LEAST_WORDS} or 100 * n_repeat_words > 50 * n_words as base_failed from measured),
patterns as (select list({{'votes': votes, 'n': n}} order by votes) as p from (select votes, count(*)::double as n from voted where not base_failed group by 1)),
steps(i, prior, on_good, on_bad) as (
  select 0, {quality.PRIOR}::double, list_transform({js}, lambda j: {quality.ON_GOOD}::double), list_transform({js}, lambda j: {quality.ON_BAD}::double)
  union all
  select i + 1, least(greatest(list_sum(list_transform(q, lambda x: x.n * x.g)) / list_sum(list_transform(q, lambda x: x.n)), 0.01), 0.99),
    {learnt("+", "x.g", quality.ON_GOOD, quality.WITHIN_GOOD)}, {learnt("-", "(1 - x.g)", quality.ON_BAD, quality.WITHIN_BAD)}
  from (select i, list_transform(p, lambda x: {{'votes': x.votes, 'n': x.n, 'g': {posterior("x.votes")}}}) as q from steps, patterns where i < {quality.STEPS})),
judged as (select v.*, round({posterior("votes")}, 6) as quality from voted v, steps where i = {quality.STEPS})
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and quality >= {quality.LEAST_POSTERIOR} as kept, quality, votes from judged"""


# the other operators' hashes, tokenizers and models have no counterpart in SQL: they are tested against plain Python
ORACLE_SQL: dict[str, str] = {
    "op3_embedding_near_dedup": """
with recursive units as (
  select vec_id, cast(embedding as double[]) as e from embeddings where embedding is not null),
valid as (
  select * from units where len(e) > 0 and len(list_filter(e, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(e, lambda x: x <> 0)) > 0),
links as (
  select a.vec_id as a, b.vec_id as b from valid a join valid b on a.vec_id <> b.vec_id and len(a.e) = len(b.e) and list_cosine_similarity(a.e, b.e) >= 0.95),
reach(a, b) as (
  select vec_id, vec_id from embeddings union select r.a, l.b from reach r join links l on l.a = r.b)
select r.a as vec_id, (select count(*) from links where links.a = r.a) as n_links, min(r.b) as component_id, min(r.b) = r.a as kept from reach r group by r.a""",
    "op12_quality_rules": _quality_sql(),
    "op13_vector_codes": _codes_sql(),
}
