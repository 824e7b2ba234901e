"""The registered queries of the training-data operators, each over its whole table, and their SQL where there is any."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, clustering, common, exact_dedup, language, line_dedup, mixing, packing, quality, simhash, sketch, toxicity, whitening

TOKENIZER = "word_bpe_49k.json"


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that may be learned from, with their labels."""
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = common.table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    return docs.where(~common.held_out(F.col("doc_id"), 5, 0)).join(labels, "doc_id")


def tokenizer_file(path: str | None = None) -> str:
    """The content of the tokenizer file at path, by default that of the installed public vocabularies."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(TOKENIZER)
    return bpe.read_tokenizer(path)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = toxicity.fit_toxicity(_labelled(spark, sf_dir))
    found = toxicity.score_toxicity(common.table(spark, sf_dir, "documents"), model)
    return found.select("doc_id", common.held_out(F.col("doc_id"), 5, 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "spans")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mixing.mix_sources(common.table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return found.select("doc_id", "source", "mix_repeat", "mix_weight", "mix_position", mixing.doc_tokens(F.col("text")).alias("n_tokens"))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(common.table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_file(), ids=False)


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketch.fingerprint_documents(common.table(spark, sf_dir, "documents"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup.exact_dedup(common.table(spark, sf_dir, "documents"), keep="largest")
    return found.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    out = common.held_out(F.col("doc_id"), 4, 2)
    found = language.identify_language(docs, language.fit_language(docs.where(~out)))
    return found.select("doc_id", out.alias("held_out"), "lang_pred", "score", "margin", "rejected")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_components(common.table(spark, sf_dir, "documents"))


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    rows = common.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return chat.read_back(chat.format_chats(rows))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = quality.fit_quality(_labelled(spark, sf_dir))
    found = quality.score_quality(common.table(spark, sf_dir, "documents"), model)
    return found.select("doc_id", common.held_out(F.col("doc_id"), 5, 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.line_dedup(common.table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_lines", "n_deleted", F.length("text").cast("long").alias("chars_left"), F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("text_sha256"))


def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.cluster(common.table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(common.table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def op13_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(common.table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_file(), ids=False)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_toxicity, op2_mixing, op3_bpe, op4_fingerprints, op5_exact_dedup, op6_language, op7_simhash, op8_chat, op9_quality, op10_line_dedup, op11_centroid_clustering, op12_embedding_whitening, op13_best_fit_packing)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op2_mixing": MIXING_SQL, "op5_exact_dedup": EXACT_SQL, "op10_line_dedup": LINES_SQL, "op11_centroid_clustering": _clustering_sql()}


def _clustering_sql(k: int = 40, rounds: int = 5) -> str:
    """Every distance to every centroid in whole numbers; a round is two steps."""
    parts = ["""t as materialized (select row_number() over () as i, vec_id, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as v from embeddings
  where len(embedding) = 64 and list_bool_and(list_transform(embedding, lambda x: x is not null and isfinite(x))))""", f"""c0 as materialized (select row_number() over (order by h, v) - 1 as c, v from (select sha256('2:' || coalesce(cast(vec_id as varchar), '')) as h, v from t order by h, v limit {k}))"""]
    far = "cast(list_sum(list_transform(list_zip(t.v, m.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) as bigint)"
    for r in range(rounds + 1):
        parts.append(f"a{r} as materialized (select t.i, min(struct_pack(d := {far}, c := m.c)) as b from t cross join c{r} m group by t.i)")
        if r < rounds:
            parts.append(f"""s{r} as materialized (select c, j, sum(x) as s, count(*) as n from (select a.b.c as c, unnest(range(1, 65)) as j, unnest(t.v) as x from t join a{r} a on t.i = a.i) group by c, j)""")
            parts.append(f"""c{r + 1} as materialized (select m.c, coalesce(o.v, m.v) as v from c{r} m left join (select c, list(cast((s - ((s % n) + n) % n) // n as bigint) order by j) as v from s{r} group by c) o on m.c = o.c)""")
    last = f"""select t.vec_id, cast(a.b.c as int) as cluster, a.b.d as distance, cast(sum(a.b.d) over (partition by a.b.c) as bigint) as cluster_inertia, cast(sum(a.b.d) over () as bigint) as inertia, sha256(array_to_string(m.v, ',')) as centroid_sha256
  from t join a{rounds} a on t.i = a.i join c{rounds} m on m.c = a.b.c"""
    return "with " + ",\n".join(parts) + "\n" + last


EXACT_SQL = """
with t as (select doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as norm from documents),
g as (select norm, max(doc_id) as keep_id, count(*) as group_size from t group by norm)
select t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id as kept, sha256(t.norm) as text_sha256 from t join g using (norm)"""

#: The exponents by plain bisection (be: entropy, br: repeats), then the blocks' and documents' running sums.
MIXING_SQL = r"""
with recursive rows_ as (select source, coalesce(cast(doc_id as varchar), 'null') || '/' || md5(coalesce(text, '')) as k, doc_id, len(regexp_extract_all(coalesce(text, ''), '\S+')) as n from documents),
r as (select source, k, any_value(doc_id) as doc_id, sum(n) as n, count(*) as copies from rows_ where n > 0 group by source, k),
tt as (select source, cast(sum(n) as double) as tokens, count(*) as docs from r group by source),
sh as (select *, tokens / sum(tokens) over () as p, sum(tokens) over () as whole from tt),
be(i, lo, hi) as (select 0, 0e0, 1e0 union all select i + 1,
    case when (select ln(sum(pow(p, (lo + hi) / 2))) - sum(pow(p, (lo + hi) / 2) * ln(pow(p, (lo + hi) / 2))) / sum(pow(p, (lo + hi) / 2)) >= 0.98 * ln(count(*)) from sh) then (lo + hi) / 2 else lo end,
    case when (select ln(sum(pow(p, (lo + hi) / 2))) - sum(pow(p, (lo + hi) / 2) * ln(pow(p, (lo + hi) / 2))) / sum(pow(p, (lo + hi) / 2)) >= 0.98 * ln(count(*)) from sh) then hi else (lo + hi) / 2 end from be where i < 34),
br(i, lo, hi) as (select 0, 0e0, 1e0 union all select i + 1,
    case when (select max(pow(p, (lo + hi) / 2) / tokens) / sum(pow(p, (lo + hi) / 2)) * max(whole) >= 4 from sh) then (lo + hi) / 2 else lo end,
    case when (select max(pow(p, (lo + hi) / 2) / tokens) / sum(pow(p, (lo + hi) / 2)) * max(whole) >= 4 from sh) then hi else (lo + hi) / 2 end from br where i < 34),
al as (select case when (select count(*) from sh) < 2 then 1e0 else greatest(
    case when (select ln(sum(p)) - sum(p * ln(p)) / sum(p) >= 0.98 * ln(count(*)) from sh) then 1e0 else (select floor(lo * 1e6) / 1e6 from be where i = 34) end,
    case when (select max(1 / tokens) / count(*) * max(whole) <= 4 from sh) then 0e0 else (select least(1e0, ceil(lo * 1e6) / 1e6) from br where i = 34) end) end as a),
pl as (select source, tokens, round(pow(p, a) / sum(pow(p, a)) over (), 9) as weight, whole, ceil(docs / 1000e0) as blocks from sh, al),
q as (select *, cast(least(floor(weight * whole), floor(tokens * 4e0)) as bigint) as quota from pl),
bl as (select r.*, cast(('0x' || substr(md5('mix/' || k), 1, 15)) as bigint) % cast(blocks as bigint) as block from r join q on r.source is not distinct from q.source),
sz as (select source, block, sum(n) as size from bl group by source, block),
cp as (select sz.source, block, size, weight, tokens, quota, unnest(range(0, greatest(1, cast(ceil(quota / tokens) as bigint)))) as rep from sz join q on sz.source is not distinct from q.source),
ob as (select *, rep * tokens + coalesce(sum(size) over (partition by source, rep order by cast(('0x' || substr(md5('mix/' || rep || '/' || block), 1, 15)) as bigint), block rows between unbounded preceding and 1 preceding), 0) as before from cp),
dr as (select bl.*, ob.rep, ob.weight, ob.quota, before + coalesce(sum(bl.n) over (partition by bl.source, ob.rep, bl.block order by cast(('0x' || substr(md5('mix/' || ob.rep || '/' || k), 1, 15)) as bigint), k rows between unbounded preceding and 1 preceding), 0) as position
   from bl join ob on bl.source is not distinct from ob.source and bl.block = ob.block and ob.before < ob.quota)
select doc_id, source, cast(rep as int) as mix_repeat, weight as mix_weight, cast(position as bigint) as mix_position, cast(n / copies as bigint) as n_tokens from dr, range(cast(copies as bigint)) where position < quota"""

#: By the definition's shortest windows: for each line the least run of 40 words from it on and up to it, compared as text.
LINES_SQL = r"""
with d as (select doc_id, text, string_split(text, chr(10)) as ls from documents where text is not null),
l as (select doc_id, unnest(range(len(ls))) as pos, unnest(ls) as line from d),
c as (select *, len(regexp_extract_all(line, '\S+')) as words, sum(len(regexp_extract_all(line, '\S+'))) over (partition by doc_id order by pos) as up from l),
x as (select a.doc_id, a.pos as a, b.pos as b from c a join c b on a.doc_id = b.doc_id and b.pos >= a.pos and b.up - a.up + a.words >= 40),
r as (select doc_id, a, min(b) as b from x group by doc_id, a union select doc_id, max(a) as a, b from x group by doc_id, b),
t as (select r.doc_id, r.a, r.b, string_agg(c.line, chr(10) order by c.pos) as body from r join c on r.doc_id = c.doc_id and c.pos between r.a and r.b group by r.doc_id, r.a, r.b),
f as (select *, row_number() over (partition by body, b - a order by doc_id, a) as n from t),
g as (select distinct f.doc_id, c.pos from f join c on f.doc_id = c.doc_id and c.pos between f.a and f.b where n > 1),
o as (select c.doc_id, count(*) as n_lines, count(g.pos) as n_deleted, coalesce(string_agg(c.line, chr(10) order by c.pos) filter (where g.pos is null), '') as left_text from c left join g on c.doc_id = g.doc_id and c.pos = g.pos group by c.doc_id)
select e.doc_id, cast(coalesce(n_lines, 0) as int) as n_lines, cast(coalesce(n_deleted, 0) as int) as n_deleted, length(left_text) as chars_left, sha256(coalesce(left_text, '')) as text_sha256 from documents e left join o on e.doc_id = o.doc_id"""
