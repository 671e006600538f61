"""The registered queries over the given tables: thin digests of what the operators return."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from tablewright.llm import (
    conversations, exact_dedup, jaccard, language, mixing, packing, periodic, pieces, records, secret_scan,
    substring_dedup, topk, toxicity,
)
from tablewright.session import shared_folder

TOKENIZER = "word_bpe_49k.json"
END_ID = 2
PIECE_MODEL = "piece_bpe_32k.model"


def _documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")


def op1_token_records(spark: SparkSession, folder: str) -> DataFrame:
    path = shared_folder(spark)
    records.write_token_records(_documents(spark, folder), path, public_tokenizers.path(TOKENIZER), END_ID)
    back = records.read_token_records(spark, path)
    digests = back.select("file_number", "offset", "doc_id", "n_tokens", F.crc32("ids").alias("ids_crc32"))
    starts = records.read_index(spark, path).select("file_number", "offset", "start")
    return digests.join(starts, ["file_number", "offset"]).select("doc_id", "start", "n_tokens", "ids_crc32")


def op2_hierarchical_packing(spark: SparkSession, folder: str) -> DataFrame:
    pieces = packing.pack_documents(_documents(spark, folder), public_tokenizers.path(TOKENIZER), END_ID)
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset",
        "window", "step_group",
    )


def op3_count_min_substrings(spark: SparkSession, folder: str) -> DataFrame:
    left = substring_dedup.remove_repeats(_documents(spark, folder))
    return left.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op4_string_kernel_language(spark: SparkSession, folder: str) -> DataFrame:
    return language.identify_languages(_documents(spark, folder))


def op5_trigram_secrets(spark: SparkSession, folder: str) -> DataFrame:
    spans = F.col("spans")
    base = F.filter(spans, lambda s: s["rank"] < len(secret_scan.BASE_RULES))

    def count(rank):  # a second argument of the function given to filter would be the position
        return F.size(F.filter(spans, lambda s: s["rank"] == rank)).cast("long")

    counts = [count(rank).alias(f"n_{rule.kind}") for rank, rule in enumerate(secret_scan.BASE_RULES)]
    found = secret_scan.find_secrets(_documents(spark, folder))
    return found.select(
        "doc_id", *counts, F.sha2(secret_scan.span_text(base), 256).alias("base_sha256"), secret_scan.span_text(spans).alias("spans")
    )


def op6_cube_mixing(spark: SparkSession, folder: str) -> DataFrame:
    mixed = mixing.mix_sources(_documents(spark, folder))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


def op7_bit_sliced_topk(spark: SparkSession, folder: str) -> DataFrame:
    rows = spark.read.parquet(f"{folder}/embeddings.parquet")
    return topk.top_k(rows, rows.filter("vec_id % 20 = 0"), 20, 64)


def op8_classifier_chain(spark: SparkSession, folder: str) -> DataFrame:
    labels = spark.read.parquet(f"{folder}/labels.parquet").withColumn("low_quality", 1 - F.col("quality"))
    found = toxicity.classify_toxicity(_documents(spark, folder), labels, ["low_quality", "toxic"])
    return found.select("doc_id", "p_low_quality", "p_toxic", F.col("flagged").cast("int").alias("toxic"))


def op9_rare_first_jaccard(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard.similar_groups(_documents(spark, folder))


def op10_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    groups = exact_dedup.exact_groups(_documents(spark, folder))
    return groups.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op11_piece_agenda(spark: SparkSession, folder: str) -> DataFrame:
    coded = pieces.encode_pieces(_documents(spark, folder), public_tokenizers.path(PIECE_MODEL))
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        "agrees",
    )


def op12_frequency_split_runs(spark: SparkSession, folder: str) -> DataFrame:
    found = periodic.find_runs(periodic.repeat_tails(_documents(spark, folder)))
    line = F.transform("runs", lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n")))
    best = found.select("*", periodic.longest_run().alias("best"))
    length, period = F.col("best.length"), -F.col("best.p")
    return best.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("best.s")).alias("start"),
        length.alias("length"),
        period.alias("period"),
        F.floor(1000 * length / period).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(line, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op13_lightest_repair(spark: SparkSession, folder: str) -> DataFrame:
    rows = spark.read.parquet(f"{folder}/conversations.parquet")
    repair = conversations.repair_conversations(conversations.damage(rows))
    return conversations.with_all_conversations(
        repair.conversations, conversations.rows_digest(repair.rows), rows
    )


QUERIES = {
    "pipeline": corpus_pipeline.run,
    "op1_token_records": op1_token_records,
    "op2_hierarchical_packing": op2_hierarchical_packing,
    "op3_count_min_substrings": op3_count_min_substrings,
    "op4_string_kernel_language": op4_string_kernel_language,
    "op5_trigram_secrets": op5_trigram_secrets,
    "op6_cube_mixing": op6_cube_mixing,
    "op7_bit_sliced_topk": op7_bit_sliced_topk,
    "op8_classifier_chain": op8_classifier_chain,
    "op9_rare_first_jaccard": op9_rare_first_jaccard,
    "op10_exact_dedup": op10_exact_dedup,
    "op11_piece_agenda": op11_piece_agenda,
    "op12_frequency_split_runs": op12_frequency_split_runs,
    "op13_lightest_repair": op13_lightest_repair,
}

#: CRC-32 of a text in SQL: a fold over its characters, eight shifts after each.
CRC32_SQL = """xor(list_reduce([4294967295::bigint] || flatten(list_transform(string_split({0}, ''), lambda c: [ascii(c)::bigint, -1, -1, -1, -1, -1, -1, -1, -1])),
        lambda r, o: case when o >= 0 then xor(r, o) else xor(r >> 1, 3988292384 * (r & 1)) end), 4294967295)"""

SUBSTRINGS_SQL = r"""
    with w as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as ws from documents),
    g as (select doc_id, i, array_to_string(ws[i:i + 12], ' ') as gram from (select *, unnest(range(1, len(ws) - 11)) as i from w)),
    f as (select gram, min(doc_id) as least from g group by gram),
    gone as (select distinct doc_id, unnest(range(i, i + 13)) as k from g join f using (gram) where least < doc_id),
    k as (select doc_id, unnest(ws) as word, generate_subscripts(ws, 1) as k from w),
    kept as (select doc_id, string_agg(word, ' ' order by k) as text, count(*) as n from k anti join gone using (doc_id, k) group by doc_id)
    select doc_id, cast(len(ws) as bigint) as n_words, len(ws) - coalesce(n, 0) as n_removed, sha256(coalesce(kept.text, '')) as kept_sha256
    from w left join kept using (doc_id)"""

SIMILAR_SQL = r"""
    with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[^\x20\x09-\x0D]+') as ws from documents),
    s as (select distinct doc_id, array_to_string(ws[i:i + 4], ' ') as gram from (select *, unnest(range(1, greatest(len(ws) - 3, 2))) as i from w where len(ws) > 0)),
    n as (select doc_id, count(*) as n from s group by doc_id),
    p as (select a.doc_id as a, b.doc_id as b, count(*) as common from s a join s b on a.gram = b.gram and a.doc_id <> b.doc_id group by all),
    links as (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * common >= 75 * (x.n + y.n - common)),
    reach as (select doc_id as a, doc_id as b from n union select reach.a, links.b from reach join links on reach.b = links.a)
    select w.doc_id, coalesce(n.n, 0) as n_shingles, coalesce(r.root, w.doc_id) as component_id
    from w left join n using (doc_id) left join (select a, min(b) as root from reach group by a) r on r.a = w.doc_id"""

RUNS_SQL = r"""
    with w as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as ws, """ + CRC32_SQL.format("cast(doc_id as varchar)") + r""" as h from documents),
    x as (select *, len(ws) as n, h // 10 as g, case when h % 10 = 0 and len(ws) > 0 then (h // 10) % len(ws) end as a from w),
    y as (select *, 1 + (n - a) // (3 + g % 8) as p from x),
    z as (select doc_id, i, case when a is null or i < a then ws[i + 1] else ws[a + (i - a) % p + 1] end as word, n from (select *, unnest(range(0, n)) as i from y)),
    e as (select l.doc_id, l.i, r.i - l.i as q from z l join z r on l.doc_id = r.doc_id and l.word = r.word and r.i > l.i and 4 * (r.i - l.i) <= l.n),
    o as (select *, i - row_number() over (partition by doc_id, q order by i) as island from e),
    s as (select doc_id, q, min(i) as start, count(*) + q as length from o group by doc_id, q, island having count(*) + q >= greatest(6, 4 * q)),
    runs as (select doc_id, start, length, min(q) as period from s group by all),
    gone as (select distinct doc_id, unnest(range(start + period, start + length)) as i from runs),
    kept as (select doc_id, string_agg(word, ' ' order by i) as text from z anti join gone using (doc_id, i) group by doc_id),
    b as (select doc_id, count(*) as n, arg_min(struct_pack(start, length, period), struct_pack(l := -length, s := start, p := period)) as best,
             string_agg(start || ',' || length || ',' || period || chr(10), '' order by start, period) as lines from runs group by doc_id)
    select w.doc_id, coalesce(b.n, 0) as n_runs, best.start as start, best.length as length, best.period as period,
      cast(1000 * best.length // best.period as bigint) as exponent_milli, sha256(coalesce(lines, '')) as runs_sha256, sha256(coalesce(kept.text, '')) as collapsed_sha256
    from w left join b using (doc_id) left join kept using (doc_id)"""

REPAIR_SQL = r"""
    with recursive named as (select *, """ + CRC32_SQL.format("coalesce(cast(conv_id as varchar), ' ') || ':' || coalesce(cast(turn as varchar), ' ')") + r""" % 20 as fault from conversations),
    made as (select conv_id, turn, case when fault = 4 then 'user' else coalesce(role, ' ') end as role,
               case fault when 1 then '' when 2 then translate(coalesce(text, ' '), '.!?', '') else coalesce(text, ' ') end as text,
               unnest(range(case fault when 0 then 0 when 3 then 2 else 1 end)) as copy from named),
    told as (select *, row_number() over (partition by conv_id order by turn nulls first, sha256(length(role) || ':' || role || text)) as i,
               left(role, 1) as initial from made),
    r as (select *, case when not regexp_matches(text, '[^\x20\x09-\x0D]') then 'blank'
               when row_number() over (partition by conv_id, role, text order by i) > 1 then 'duplicate'
               when not regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') then 'truncated' else 'fine' end as kind,
               lag(initial) over (partition by conv_id order by i) || initial as pair from told),
    c as (select conv_id, max(i) as n, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (kind = 'blank') as blank,
            count(*) filter (kind = 'duplicate') as duplicate, count(*) filter (kind = 'truncated') as truncated,
            count(*) filter (pair not in ('su', 'ua', 'au')) as illegal from r group by conv_id),
    path as (
      select conv_id, n, 0::bigint as i, {'c': 0::bigint, 'a': '', 't': ''} as z, {'c': 1000000000::bigint, 'a': '', 't': ''} as s,
        {'c': 1000000000::bigint, 'a': '', 't': ''} as u, {'c': 1000000000::bigint, 'a': '', 't': ''} as v from c
      union all
      select conv_id, n, i, {'c': z.c + 4, 'a': z.a || 'D', 't': z.t},
        list_min([{'c': s.c + 4, 'a': s.a || 'D', 't': s.t}, {'c': case when live and initial = 's' then z.c + more else 1000000000 end, 'a': z.a || 'K', 't': z.t || own}]),
        list_min([{'c': u.c + 4, 'a': u.a || 'D', 't': u.t}]
          || list_transform([z, s, v], lambda x: {'c': case when live and initial = 'u' then x.c + more else 1000000000 end, 'a': x.a || 'K', 't': x.t || own})
          || list_transform([z, s, v], lambda x: {'c': case when live then x.c + 3 + more else 1000000000 end, 'a': x.a || 'R', 't': x.t || 'user:' || text || chr(10)})),
        list_min([{'c': v.c + 4, 'a': v.a || 'D', 't': v.t}, {'c': case when live and initial = 'a' then u.c + more else 1000000000 end, 'a': u.a || 'K', 't': u.t || own},
          {'c': case when live then u.c + 3 + more else 1000000000 end, 'a': u.a || 'R', 't': u.t || 'assistant:' || text || chr(10)}])
      from (select path.conv_id, n, path.i + 1 as i, z, s,
              list_min([u] || list_transform([z, s, v], lambda x: {'c': x.c + 3, 'a': x.a || 'I', 't': x.t || 'user:' || chr(10)})) as u,
              list_min([v, {'c': u.c + 3, 'a': u.a || 'I', 't': u.t || 'assistant:' || chr(10)}]
                || list_transform([z, s], lambda x: {'c': x.c + 6, 'a': x.a || 'II', 't': x.t || 'user:' || chr(10) || 'assistant:' || chr(10)})) as v,
              kind in ('fine', 'truncated') as live, case when kind = 'truncated' then 3 else 0 end as more, initial, text, role || ':' || text || chr(10) as own
            from path join r on r.conv_id is not distinct from path.conv_id and r.i = path.i + 1)),
    best as (select conv_id, list_min([z, v, {'c': u.c + 3, 'a': u.a || 'I', 't': u.t || 'assistant:' || chr(10)},
               {'c': s.c + 6, 'a': s.a || 'II', 't': s.t || 'user:' || chr(10) || 'assistant:' || chr(10)}]) as x from path where i = n)
    select ids.conv_id, coalesce(gaps, 0) as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate, coalesce(truncated, 0) as truncated,
      coalesce(illegal, 0) as illegal, coalesce(x.c, 0) as cost, coalesce(x.a, '') as audit, sha256(coalesce(x.t[:-2], '')) as repaired_sha256
    from (select distinct conv_id from conversations) ids left join c on c.conv_id is not distinct from ids.conv_id
      left join best on best.conv_id is not distinct from ids.conv_id"""

ORACLES = {
    "op3_count_min_substrings": SUBSTRINGS_SQL,
    "op9_rare_first_jaccard": SIMILAR_SQL,
    "op12_frequency_split_runs": RUNS_SQL,
    "op13_lightest_repair": REPAIR_SQL,
    "op7_bit_sliced_topk": """
        with v as (select vec_id, list_transform(embedding, lambda x: cast(floor(64 * x::double) as bigint)) as e
                   from embeddings where embedding is not null and vec_id is not null
                     and len(list_filter(embedding, lambda x: x is null or not isfinite(x::double))) = 0),
        s as (select q.vec_id as query_id, c.vec_id, cast(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) as bigint) as score
              from v q join v c on q.vec_id <> c.vec_id and len(q.e) = len(c.e) where q.vec_id % 20 = 0),
        r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s)
        select query_id, cast(rank as integer) as rank, vec_id, score from r where rank <= 20""",
    "op10_exact_dedup": r"""
        with d as (select doc_id, coalesce(text, '') as t,
                          regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') as n from documents),
        g as (select *, first_value(doc_id) over (partition by n order by length(t) desc, doc_id) as keep_id,
                     count(*) over (partition by n) as group_size from d)
        select doc_id, keep_id, group_size, doc_id = keep_id as kept, sha256(n) as text_sha256 from g""",
}
