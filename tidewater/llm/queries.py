"""Registered queries of the training-data operators: each over its whole table."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession

from tidewater.llm.spotsigs import ANCHORS, NEAR
from tidewater.llm.tables import load


def _vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from tidewater.llm.packing import pack

    return pack(
        load(spark, sf_dir, "documents"),
        _vocabulary("byte_bpe_50k.tiktoken"),
        public_tokenizers.PATTERN,
        {"<|endoftext|>": 50256},
    )


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from tidewater.llm.bpe import round_trip

    return round_trip(
        load(spark, sf_dir, "documents"), _vocabulary("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    )


def op3_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewater.llm.ann import nearest

    return nearest(load(spark, sf_dir, "embeddings"))


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewater.llm.ngram_join import ngram_components

    return ngram_components(load(spark, sf_dir, "documents"))


def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewater.llm.chat import format_conversations, read_back

    probe = "</s>[INST] ok [/INST]"
    turns = load(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame(
        [(-7, 0, "user", probe), (-7, 1, "assistant", probe)], "conv_id long, turn long, role string, text string"
    )
    return read_back(format_conversations(turns.unionByName(extra)))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewater.llm.suffixes import repeated_passages

    return repeated_passages(load(spark, sf_dir, "documents"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewater.llm.pii import key_of, replace

    return replace(load(spark, sf_dir, "documents"), key_of(spark))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewater.llm.toxicity import fit, score

    docs = load(spark, sf_dir, "documents")
    return score(docs, fit(docs, load(spark, sf_dir, "labels")))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewater.llm.language_id import fit, identify

    docs = load(spark, sf_dir, "documents")
    return identify(docs, fit(docs))


def op10_block_naming(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewater.llm.exact_dedup import exact_dedup

    return exact_dedup(load(spark, sf_dir, "documents"))


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from tidewater.llm.alignment import alignment_digests

    ranks, model = _vocabulary("byte_bpe_50k.tiktoken"), _vocabulary("piece_bpe_32k.model")
    return alignment_digests(load(spark, sf_dir, "documents"), ranks, model, public_tokenizers.PATTERN)


def op12_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewater.llm.spotsigs import edited_fingerprints

    return edited_fingerprints(load(spark, sf_dir, "documents"))


def op13_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewater.llm.repair import damage, repair_report

    turns = load(spark, sf_dir, "conversations")
    return repair_report(turns, damage(turns))


QUERIES = {
    "op1_packing": op1_packing,
    "op2_byte_bpe": op2_byte_bpe,
    "op3_ann": op3_ann,
    "op4_ngram_join": op4_ngram_join,
    "op5_chat": op5_chat,
    "op6_suffix_dedup": op6_suffix_dedup,
    "op7_pii": op7_pii,
    "op8_toxicity": op8_toxicity,
    "op9_language_id": op9_language_id,
    "op10_block_naming": op10_block_naming,
    "op11_alignment": op11_alignment,
    "op12_spotsigs": op12_spotsigs,
    "op13_repair": op13_repair,
}

_CONTROL = ("<|im_start|>", "<|im_end|>", "<s>", "</s>", "[INST]", "[/INST]")


def _escaped_length(column: str) -> str:
    """SQL for the length of a text with its backslashes doubled and one more in every control string."""
    parts = [f"2 * length({column}) - length(replace({column}, '\\', ''))"]
    parts += [f"(length({column}) - length(replace({column}, '{c}', ''))) // {len(c)}" for c in _CONTROL]
    return "(" + " + ".join(parts) + ")"


_COMMON = ", ".join(f"'{a}'" for a in ANCHORS)
_STEP = math.log(1 / NEAR)

ORACLES = {
    "op4_ngram_join": r"""
        with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
            'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as ws from documents),
          g as (select doc_id, unnest(list_distinct(case when len(ws) >= 5
            then list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))
            when len(ws) > 0 then [array_to_string(ws, ' ')] else [] end)) as g from w),
          n as (select doc_id, count(*) as n from g group by 1),
          p as (select a.doc_id as a, b.doc_id as b, count(*) as k from g a join g b on a.g = b.g and a.doc_id < b.doc_id group by 1, 2),
          l as (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * k >= 80 * (x.n + y.n - k)),
          e as (select a, b from l union all select b, a from l),
          r as (select doc_id, doc_id as c from documents union select r.doc_id, e.b from r join e on e.a = r.c)
        select r.doc_id, coalesce(max(n.n), 0) as n_shingles, min(r.c) as component_id from r left join n using (doc_id) group by 1
    """,
    "op5_chat": f"""
        with t as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
          union all select -7, 0, 'user', '</s>[INST] ok [/INST]' union all select -7, 1, 'assistant', '</s>[INST] ok [/INST]')
        select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
          cast(sum(case when role = 'assistant' then length(text) else 0 end) as bigint) as loss_chars,
          sha256(coalesce(string_agg(case when role = 'assistant' then text end, '' order by turn, role, text), '')) as loss_sha256,
          cast(sum({12 + 10 + 2} + {_escaped_length("role")} + length(role) - length(replace(role, chr(10), '')) + {_escaped_length("text")}) as bigint) as formatted_chars
        from t group by 1
    """,
    "op6_suffix_dedup": r"""
        with w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
            'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as ws from documents),
          s as (select doc_id, ws, unnest(range(0, len(ws) - 49)) as i from w where len(ws) >= 50),
          g as (select doc_id, i, md5(array_to_string(ws[i + 1:i + 50], ' ')) as g from s),
          r as (select g, min(doc_id) as first from g group by 1 having min(doc_id) <> max(doc_id)),
          h as (select distinct doc_id, i, doc_id > first as later from g join r using (g)),
          j as (select *, case when i - lag(i) over (partition by doc_id, later order by i) <= 50 then 0 else 1 end as new from h),
          k as (select *, sum(new) over (partition by doc_id, later order by i rows unbounded preceding) as run from j)
        select doc_id, later, min(i) as start_word, max(i) - min(i) + 50 as n_words from k group by doc_id, later, run
    """,
    "op10_block_naming": """
        select doc_id, max(doc_id) over same as keep_id, count(*) over same as group_size,
          doc_id = max(doc_id) over same as kept, sha256(coalesce(text, '')) as text_sha256
        from documents window same as (partition by coalesce(text, ''))
    """,
    "op12_spotsigs": rf"""
        with d as (select doc_id, coalesce(text, '') as t from documents),
          o as (select doc_id, t, length(t) as n, coalesce(lead(t) over w, first_value(t) over w) as nt, coalesce(lead(doc_id) over w, first_value(doc_id) over w) as nid
            from d window w as (order by doc_id desc rows between unbounded preceding and unbounded following)),
          e as (select *, left(t, n - n // 2) || left(nt, n // 2) as edited from o),
          x as (select doc_id, 0 as k, t as x from e union all select doc_id, 1, edited from e),
          s as (select doc_id, k, x, trim(regexp_replace(lower(x), '[^\p{{L}}\p{{N}}]+', ' ', 'g')) as s from x),
          w as (select doc_id, k, unnest(string_split(s, ' ')) as w, generate_subscripts(string_split(s, ' '), 1) as i from s),
          a as (select *, w in ({_COMMON}) as common, lag(w) over (partition by doc_id, k order by i) as before from w),
          c as (select doc_id, k, before, w || ' ' || lead(w, 1) over v || ' ' || lead(w, 2) over v as chain from a where not common window v as (partition by doc_id, k order by i)),
          g as (select distinct doc_id, k, left(md5(before || ' ' || chain), 16) as g from c where before in ({_COMMON}) and chain is not null),
          f as (select s.doc_id, s.k, case when count(g.g) = 0 then [left(md5(case when any_value(s.s) <> '' then any_value(s.s) else any_value(s.x) end), 16)] else list(g.g order by g.g) end as f
            from s left join g using (doc_id, k) group by 1, 2)
        select e.doc_id, e.n as n_chars, sha256(e.edited) as edited_sha256, array_to_string(a.f, '') as fingerprint, array_to_string(b.f, '') as edited_fingerprint,
          len(list_intersect(a.f, b.f)) / (len(a.f) + len(b.f) - len(list_intersect(a.f, b.f))) as near_edited,
          len(list_intersect(a.f, z.f)) / (len(a.f) + len(z.f) - len(list_intersect(a.f, z.f))) as near_next,
          cast(len(a.f) as int) as n_signatures, cast(floor(ln(cast(len(a.f) as double)) / {_STEP!r}) as int) as length_partition
        from e join f a on a.doc_id = e.doc_id and a.k = 0 join f b on b.doc_id = e.doc_id and b.k = 1 join f z on z.doc_id = e.nid and z.k = 0
    """,
    "op13_repair": r"""
        with recursive c as (select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
            coalesce(cast(conv_id as varchar), ' ') || ':' || coalesce(cast(turn as varchar), ' ') as key from conversations),
          steps as (select *, list_concat([4294967295], flatten(list_transform(string_split(key, ''), lambda x: [256 + ascii(x), 0, 0, 0, 0, 0, 0, 0, 0]))) as bits from c),
          hashed as (select *, xor(list_reduce(bits, lambda h, x: case when x >= 256 then xor(h, x - 256) when h % 2 = 1 then xor(h // 2, 3988292384) else h // 2 end), 4294967295) % 20 as kind from steps),
          d as (select conv_id, turn, case when kind = 4 then 'user' else role end as role,
              case kind when 1 then '' when 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text, unnest(case when kind = 3 then [0, 1] else [0] end) as copy
            from hashed where kind <> 0),
          o as (select *, row_number() over (partition by conv_id order by turn nulls first, role, text, copy) as i,
              regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) as final, left(role, 1) as initial from d),
          f as (select *, case when final = '' then 'blank' when row_number() over (partition by conv_id, role, text order by i) > 1 then 'duplicate'
              when final not in ('.', '!', '?') then 'truncated' end as fault, lag(initial) over (partition by conv_id order by i) as before from o),
          sizes as (select conv_id, count(*) as n from f group by 1),
          ins(s, t, letters, added) as (values (0, 0, '', ''), (1, 1, '', ''), (2, 2, '', ''), (3, 3, '', ''), (0, 2, 'I', e'user:\n'), (1, 2, 'I', e'user:\n'), (3, 2, 'I', e'user:\n'),
              (2, 3, 'I', e'assistant:\n'), (0, 3, 'II', e'user:\nassistant:\n'), (1, 3, 'II', e'user:\nassistant:\n'), (2, 2, 'II', e'assistant:\nuser:\n'), (3, 3, 'II', e'user:\nassistant:\n')),
          edits(initial, s, t, letter, price, role) as (values ('*', 0, 0, 'D', 2, ''), ('*', 1, 1, 'D', 2, ''), ('*', 2, 2, 'D', 2, ''), ('*', 3, 3, 'D', 2, ''),
              ('s', 0, 1, 'K', 0, ''), ('u', 0, 2, 'K', 0, ''), ('u', 1, 2, 'K', 0, ''), ('u', 3, 2, 'K', 0, ''), ('a', 2, 3, 'K', 0, ''),
              ('*', 0, 2, 'R', 1, 'user'), ('*', 1, 2, 'R', 1, 'user'), ('*', 3, 2, 'R', 1, 'user'), ('*', 2, 3, 'R', 1, 'assistant')),
          b as (
            select conv_id, cast(0 as bigint) as i, 0 as s, {'cost': 0, 'audit': '', 'lines': ''} as v from sizes
            union all
            select b.conv_id, f.i, edits.t, min({'cost': b.v.cost + 5 * length(ins.letters) + edits.price + case when f.fault = 'truncated' and letter <> 'D' then 5 else 0 end,
              'audit': b.v.audit || ins.letters || edits.letter,
              'lines': b.v.lines || ins.added || case letter when 'D' then '' when 'K' then f.role || ':' || f.text || chr(10) else edits.role || ':' || f.text || chr(10) end})
            from b join f on f.conv_id is not distinct from b.conv_id and f.i = b.i + 1 join ins on ins.s = b.s
              join edits on edits.s = ins.t and (edits.initial = '*' or edits.initial = f.initial) and (letter = 'D' or coalesce(f.fault, '') not in ('blank', 'duplicate'))
            group by 1, 2, 3),
          ends as (select b.conv_id, min({'cost': b.v.cost + 5 * length(ins.letters), 'audit': b.v.audit || ins.letters, 'lines': b.v.lines || ins.added}) as v
            from b join sizes on sizes.conv_id is not distinct from b.conv_id and sizes.n = b.i join ins on ins.s = b.s where ins.t in (0, 3) group by 1),
          counts as (select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (fault = 'blank') as blank,
              count(*) filter (fault = 'duplicate') as duplicate, count(*) filter (fault = 'truncated') as truncated,
              count(*) filter (before is not null and before || initial not in ('su', 'ua', 'au')) as illegal from f group by 1)
        select k.conv_id, coalesce(gaps, 0) as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate, coalesce(truncated, 0) as truncated,
          coalesce(illegal, 0) as illegal, cast(coalesce(v.cost, 0) as bigint) as cost, coalesce(v.audit, '') as audit,
          sha256(coalesce(left(v.lines, length(v.lines) - 1), '')) as repaired_sha256
        from (select distinct conv_id from conversations) k left join counts on counts.conv_id is not distinct from k.conv_id left join ends on ends.conv_id is not distinct from k.conv_id
    """,
}
