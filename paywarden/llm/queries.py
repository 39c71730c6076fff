"""Registered queries of the operators, with production parameters over whole tables, and their DuckDB texts."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paywarden.llm.common import read


def tokenizer_path() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from paywarden.llm.bpe import encode_decode
    done = encode_decode(read(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_path())
    return done.select("doc_id", (F.length("token_ids") / 4).cast("long").alias("n_tokens"),
                       F.sha2("token_ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from paywarden.llm.line_dedup import drop_boilerplate
    return drop_boilerplate(read(spark, sf_dir, "documents")).select("doc_id", "source", "text", "n_lines", "n_dropped")


OP2_SQL = """
with pages as (select doc_id, source, text, string_split(text, chr(10)) as lines from documents),
totals as (select source, count(*) as host_pages from documents group by source),
counts as (select source, line, count(*) as pages
           from (select source, unnest(list_distinct(lines)) as line from pages) where trim(line) <> '' group by source, line),
bad as (select c.source, list(c.line) as drop_lines from counts c join totals t on c.source is not distinct from t.source
        where c.pages >= 5 and c.pages > 0.1 * t.host_pages group by c.source),
cut as (select p.doc_id, p.source, p.text, p.lines, list_filter(p.lines, lambda x: not coalesce(list_contains(b.drop_lines, x), false)) as stay
        from pages p left join bad b on p.source is not distinct from b.source)
select doc_id, source, case when text is not null then array_to_string(stay, chr(10)) end as text,
       coalesce(len(lines), 0)::int as n_lines, coalesce(len(lines) - len(stay), 0)::int as n_dropped from cut
"""


def op3_embedding_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    from paywarden.llm.flat_graph import links
    return links(read(spark, sf_dir, "embeddings"))


def op4_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    from paywarden.llm.substring import remove_repeats
    return remove_repeats(read(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "text", "n_sentences", "n_removed")


def op5_near_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    from paywarden.llm.order_minhash import classes
    return classes(read(spark, sf_dir, "documents")).select("doc_id", "class_id", "kept", "class_size")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from paywarden.llm.langid import held_out
    from paywarden.llm.toxicity import fit, score
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    labels = read(spark, sf_dir, "labels").filter(~held_out("doc_id", 3, 1))
    return score(docs, fit(docs, labels)).select("doc_id", held_out("doc_id", 3, 1).alias("held_out"), "score", "predicted")


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from paywarden.llm.langid import fit, held_out, identify
    docs = read(spark, sf_dir, "documents")
    model = fit(docs.filter(~held_out("doc_id", 5, 0)))
    done = identify(docs.select("doc_id", "text"), model)
    return done.select("doc_id", held_out("doc_id", 5, 0).alias("held_out"), "lang_pred", "score", "cross_entropy", "rejected")


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from paywarden.llm.decontaminate import matches
    found = matches(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "start", F.round("similarity", 9).alias("similarity"))


OP8_SQL = r"""
with words as (select doc_id, list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda w: w <> '') as w from documents where text is not null),
doc as (select doc_id, case when len(w) < 5 then [] else list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) end as s from words),
item_words as (select item_id, list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda w: w <> '') as w from benchmark),
item as materialized (select item_id, list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) as s from item_words where len(w) >= 5),
hits as materialized (
  select d.doc_id, i.item_id, min(d.pos) as lo, max(d.pos) as hi
  from (select doc_id, unnest(s) as h, generate_subscripts(s, 1) as pos from doc) d
  join (select item_id, unnest(list_distinct(s)) as h from item) i using (h) group by all),
windows as (
  select h.doc_id, h.item_id, i.s as own, d.s as s, unnest(range(greatest(1, h.lo - len(i.s) + 1), h.hi + 1)) as pos
  from hits h join item i using (item_id) join doc d using (doc_id)),
cut as (select doc_id, item_id, own, pos, s[pos:pos + len(own) - 1] as win from windows),
common as (select doc_id, item_id, pos, len(own) + len(win) as total,
             coalesce(list_sum(list_transform(list_intersect(own, win), lambda x: least(len(list_filter(own, lambda y: y = x)), len(list_filter(win, lambda y: y = x))))), 0) as k
           from cut where len(list_intersect(own, win)) >= 0.4 * len(own))
select doc_id, item_id, (arg_max(pos, struct_pack(a := k / (total - k), b := -pos)) - 1)::int as start, round(max(k / (total - k)), 9) as similarity
from common where k / (total - k) >= 0.8 group by doc_id, item_id
"""


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from paywarden.llm.tokenbin import ids_crc32, token_files
    return token_files(read(spark, sf_dir, "documents"), tokenizer_path()).select("doc_id", "start", "n_tokens", ids_crc32().alias("ids_crc32"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from paywarden.llm.warc import archive
    return archive(read(spark, sf_dir, "pages"), min_bytes=0).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP10_SQL = """
with p as (select page_id, coalesce(html, '') as html from pages),
h as (select page_id, html, sha1(html) as hex, max(page_id) over (partition by html) as original from p)
select page_id, octet_length(encode(html))::bigint as payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
           1 + ((('0x' || substr(hex, (1 + 5 * (i // 4))::int, 5))::bigint >> (15 - 5 * (i % 4))::int) & 31)::int, 1)), '') as payload_digest,
       case when original <> page_id then 'revisit' else 'response' end as record_type,
       case when original <> page_id then original end as refers_to
from h
"""


def piece_path() -> str:
    import public_tokenizers
    return public_tokenizers.path("piece_bpe_32k.model")


def op11_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from paywarden.llm.piece import encode, ids_sha256
    done = encode(read(spark, sf_dir, "documents").select("doc_id", "text"), piece_path(), decoded="decoded")
    return done.select("doc_id", F.size("piece_ids").cast("long").alias("n_tokens"), ids_sha256().alias("ids_sha256"),
                       F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
                       F.coalesce(F.try_element_at("piece_ends", F.lit(-1)), F.lit(0)).cast("long").alias("covered_bytes"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from paywarden.llm.vector_codes import encode
    return encode(read(spark, sf_dir, "embeddings")).select("vec_id", "code", "error", "label_error", "codebooks_sha256")


def op12_sql() -> str:
    """Assigning and averaging written out for two rounds over 16 parts and 64 entries."""
    steps = []
    for k in range(3):
        steps.append(f"""
near{k} as materialized (
  select r, p, min(d * 64 + e) as m from (
    select v.r, v.p, b.e, sum((v.x - b.x) * (v.x - b.x)) as d from el v join book{k} b on v.p = b.p and v.j = b.j group by v.r, v.p, b.e)
  group by r, p)""")
        if k < 2:
            steps.append(f"""
sums{k} as (select v.p, n.m % 64 as e, v.j, sum(v.x) as s, count(*) as c from el v join near{k} n on v.r = n.r and v.p = n.p group by all),
book{k + 1} as materialized (
  select b.p, b.e, b.j, coalesce((s.s - ((s.s % s.c + s.c) % s.c)) // s.c, b.x)::bigint as x
  from book{k} b left join sums{k} s on b.p = s.p and b.e = s.e and b.j = s.j)""")
    return """
with kept as materialized (
  select row_number() over (order by vec_id, embedding) - 1 as r, vec_id, label, embedding from embeddings
  where embedding is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
size as (select len(embedding) as n from kept where r = 0),
el as materialized (
  select r, i // (n // 16) as p, i % (n // 16) as j, floor(256 * embedding[i + 1]::double)::bigint as x
  from (select r, embedding, n, unnest(range(n)) as i from kept, size where len(embedding) = n)),
book0 as materialized (select p, r as e, j, x from el where r < 64),""" + ",".join(steps) + """,
coded as (select r, string_agg(format('{:02x}', m % 64), '' order by p) as code, sum(m // 64)::bigint as error from near2 group by r)
select vec_id, code, error, (sum(error) over (partition by label))::bigint as label_error,
       (select sha256(string_agg(x::varchar, ',' order by p, e, j)) from book2) as codebooks_sha256
from coded join kept using (r)
"""


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    from paywarden.llm.phrases import phrases
    return phrases(read(spark, sf_dir, "documents"))


OP13_SQL = r"""
with pieces as (
  select coalesce(lang, 'und') as lang,
         unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece
  from documents),
lists as (select lang, row_number() over () as piece, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') as w from pieces),
flat as (select lang, piece, unnest(w) as x, generate_subscripts(w, 1) as pos from lists),
words as materialized (
  select lang, x, lead(x) over p as y, lead(x, 2) over p as z from flat window p as (partition by piece order by pos)),
grams as materialized (
  select lang, size, phrase, count(*) as f from (
    select lang, 1 as size, x as phrase from words
    union all select lang, 2, x || ' ' || y from words where y is not null
    union all select lang, 3, x || ' ' || y || ' ' || z from words where z is not null)
  group by all),
totals as (select lang, sum(f)::bigint as n from grams where size = 1 group by lang),
found as materialized (select lang, size, phrase, string_split(phrase, ' ') as w, f as a from grams where size >= 2 and f >= 10),
cuts as materialized (
  select lang, phrase, a, k, array_to_string(w[1:k], ' ') as head, array_to_string(w[k + 1:], ' ') as tail
  from (select lang, phrase, a, w, unnest(range(1, size)) as k from found)),
cut_scores as (
  select c.lang, c.phrase, c.a, c.k, l.f as l, r.f as r, (1000000::hugeint * c.a * c.a) // (l.f::hugeint * r.f) as score
  from cuts c join grams l on l.lang = c.lang and l.phrase = c.head join grams r on r.lang = c.lang and r.phrase = c.tail),
worst as (select *, row_number() over (partition by lang, phrase order by score, k) as o from cut_scores),
within as (
  select lang, part, max(a) as a from (
    select lang, a, unnest([w[1] || ' ' || w[2], w[2] || ' ' || w[3]]) as part from found where size = 3) group by lang, part),
ranked as (
  select s.lang, row_number() over (partition by s.lang order by s.score desc, s.a desc, s.phrase) as rank, s.phrase, s.a, s.l, s.r, s.score
  from worst s left join within t on t.lang = s.lang and t.part = s.phrase
  where s.o = 1 and (t.a is null or 100 * t.a < 50 * s.a))
select lang, rank, phrase, a, l, r, n, score::bigint as score from ranked join totals using (lang) where rank <= 2000
"""


def build() -> dict:
    return {
        "op1_bpe": (op1_bpe, None),
        "op2_line_dedup": (op2_line_dedup, OP2_SQL),
        "op3_embedding_copies": (op3_embedding_copies, None),
        "op4_repeats": (op4_repeats, None),
        "op5_near_copies": (op5_near_copies, None),
        "op6_toxicity": (op6_toxicity, None),
        "op7_language": (op7_language, None),
        "op8_decontaminate": (op8_decontaminate, OP8_SQL),
        "op9_token_files": (op9_token_files, None),
        "op10_warc": (op10_warc, OP10_SQL),
        "op11_sentencepiece": (op11_sentencepiece, None),
        "op12_vector_codes": (op12_vector_codes, op12_sql()),
        "op13_phrases": (op13_phrases, OP13_SQL),
    }
