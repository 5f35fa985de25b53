"""The registered queries of this subpackage: each applies its operator to whole tables and derives the result columns."""

from pyspark.sql import functions as F

from corpusq.llm import chat, decontam, digest, fim, hnsw, lookup, mixing, neardup, quality, secrets, sharding, toxicity, urls
from corpusq.llm.columns import hold, release
from corpusq.llm.labelled import crc_mod
from corpusq.plans.scratch import shared_folder
from corpusq.session import load

QUERIES, ORACLES = {}, {}


def register(name, sql=None):
    def add(query):
        QUERIES[name] = query
        if sql is not None:
            ORACLES[name] = sql
        return query
    return add


def sha256_hex(column):
    return F.sha2(column.cast("binary"), 256)


# ---- 1 secrets

# every match is fenced by two characters that no rule matches; what lies before the n-th fence gives its position
_FENCED = """
    select doc_id, '{kind}' as kind, {rank} as rank, {least} as least, {group} as part,
           string_split(regexp_replace(coalesce(text, ''), '{pattern}', chr(57344) || {mark} || chr(57345), 'g'), chr(57344)) as pieces
    from documents"""
_ASSIGN = (r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]"""
           r"""|[aA][pP][iI]_?[kK][eE][yY])["'']?\x20*[:=]\x20*["'']?""")
_SECRETS_SQL = rf"""
with fenced as (
    {_FENCED.format(kind='assign', rank=0, least=6, group=1, pattern='(' + _ASSIGN + ')([A-Za-z0-9+/_.=-]+)', mark=r"'\1' || chr(57346) || '\2'")}
    union all
    {_FENCED.format(kind='access', rank=1, least=20, group=0, pattern='(AKIA[A-Z0-9]+)', mark=r"'\1'")}
    union all
    {_FENCED.format(kind='hex', rank=2, least=24, group=0, pattern='([0-9a-f]+)', mark=r"'\1'")}
), cut as (
    select doc_id, kind, rank, least, part, pieces, unnest(range(1, len(pieces) + 1)) as n from fenced
), sized as (
    select *, pieces[n] as piece, length(replace(replace(pieces[n], chr(57345), ''), chr(57346), '')) as width,
           split_part(pieces[n], chr(57345), 1) as found
    from cut
), placed as (
    select *, coalesce(sum(width) over (partition by doc_id, kind order by n rows between unbounded preceding and 1 preceding), 0)::bigint as start,
           length(replace(found, chr(57346), '')) as size,
           case when part = 1 then length(split_part(found, chr(57346), 2)) else length(found) end as judged
    from sized
), spans as (
    select doc_id, kind, rank, start, start + size as stop from placed where n > 1 and judged >= least
), per_doc as (
    select doc_id, count(*) filter (kind = 'assign') as n_assign, count(*) filter (kind = 'access') as n_access,
           count(*) filter (kind = 'hex') as n_hex,
           string_agg(kind || ':' || start || ':' || stop, ',' order by start, rank) as spans
    from spans group by doc_id
)
select d.doc_id, coalesce(n_assign, 0)::bigint as n_assign, coalesce(n_access, 0)::bigint as n_access,
       coalesce(n_hex, 0)::bigint as n_hex, sha256(coalesce(spans, '')) as base_sha256, coalesce(spans, '') as spans
from documents d left join per_doc p on d.doc_id = p.doc_id
"""


@register("op1_secrets", _SECRETS_SQL)
def op1_secrets(spark, sf_dir):
    """Two crawls that together are the whole table, one language after all others: the second scans what the first has not seen."""
    docs = load(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    early, ledger, rules = F.col("lang").eqNullSafe("en"), None, secrets.RULES
    for crawl in (docs.filter(~early), docs.filter(early)):
        _, ledger = secrets.scan_secrets(crawl, ledger)
    found = secrets.join_findings(docs, ledger)
    return (found.select("doc_id", *[F.size(f"spans_{r.kind}").cast("bigint").alias(f"n_{r.kind}") for r in rules],
                         secrets.span_text(rules).alias("spans"))
            .select("doc_id", "n_assign", "n_access", "n_hex", sha256_hex(F.col("spans")).alias("base_sha256"), "spans"))


# ---- 2 mixing

_MIXING_SQL = r"""
with sized as (
    select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size from documents
), sources as (
    select source, sum(size)::bigint as source_size from sized group by source
), weighed as (
    select *, [1.0::double, 2.0::double, 3.0::double][((row_number() over (order by source nulls last)) - 1) % 3 + 1] as weight from sources
), levels as (
    select *, row_number() over (order by source_size / weight, source nulls last) as place,
           (sum(source_size) over ()::bigint - coalesce(sum(source_size) over (order by source_size / weight, source nulls last
               rows between unbounded preceding and 1 preceding), 0)::bigint * 3)::double
           / sum(weight) over (order by source_size / weight, source nulls last rows between current row and unbounded following) as level
    from weighed
), common as (
    select level from levels where level * weight <= source_size * 3 order by place limit 1
), rates as (
    select source, source_size, least((source_size * 3)::double, (select level from common) * weight) as target from levels
), taken as (
    select s.doc_id, s.size, r.source_size, r.target,
           case when r.source_size > 0 then r.target / r.source_size else 0 end as rate,
           ('0x' || substr(md5('mix-1:' || coalesce(s.doc_id::varchar, 'null')), 1, 13))::bigint::double / 4503599627370496.0 as u
    from sized s join rates r on s.source is not distinct from r.source
)
select doc_id, size, source_size, target,
       (size * (floor(rate) + case when u < rate - floor(rate) then 1 else 0 end))::bigint as taken
from taken
"""


@register("op2_mixing", _MIXING_SQL)
def op2_mixing(spark, sf_dir):
    docs = load(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mixing.mixing_plan(docs).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).cast("bigint").alias("taken"))


# ---- 4 chat

_CHAT_SQL = r"""
with turns as (
    select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
    union all select -7, 0, 'user', '\### Assistant: </turn> ok'
    union all select -7, 1, 'assistant', '\### Assistant: </turn> ok'
), judged as (
    select *, contains(text, '###') or contains(text, '</turn>') or contains(text, '\\') or suffix(text, '\') as escaped from turns
), made as (
    select *, case when escaped then replace(replace(replace(text, '\', '\\'), '###', '\###'), '</turn>', '\</turn>') else text end as shown from judged
)
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn)) as turns_sha256,
       coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
       sha256(coalesce(string_agg(text, '' order by turn) filter (role = 'assistant'), '')) as loss_sha256,
       sum(4 + length(role) + 2 + length(shown) + 8)::bigint as formatted_chars
from made group by conv_id
"""


@register("op4_chat", _CHAT_SQL)
def op4_chat(spark, sf_dir):
    turns = load(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = r"\### Assistant: </turn> ok"
    added = spark.createDataFrame([(-7, 0, "user", hard), (-7, 1, "assistant", hard)], turns.schema)
    return chat.read_back(chat.format_turns(turns.unionByName(added)))


# ---- 6 sharding

@register("op6_sharding")
def op6_sharding(spark, sf_dir):
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    return sharding.shard_documents(docs, keep=["doc_id"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


# ---- 7 decontamination

_DECONTAM_SQL = r"""
with item_words as (
    select item_id::varchar as item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as words from benchmark where text is not null
), starts as (
    select item, words, unnest(range(1, greatest(len(words) - 10, 0) + 2)) as place from item_words where len(words) > 0
), windows as (
    select distinct item, array_to_string(list_slice(words, place, place + 9), ' ') as window_text, least(len(words), 10) as size from starts
), doc_words as (
    select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as words from documents
), sizes as (select distinct size from windows),
places as (
    select doc_id, words, size, unnest(range(1, greatest(len(words) - size, 0) + 2)) as place from doc_words, sizes where len(words) >= size
), runs as (
    select doc_id, size, place, array_to_string(list_slice(words, place, place + size - 1), ' ') as window_text from places
), hits as (
    select doc_id, r.size, place, item from runs r join windows w on r.window_text = w.window_text and r.size = w.size
), hit_words as (
    select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(place, place + size)) as p from hits) group by doc_id
), hit_items as (
    select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as items from (select distinct doc_id, item from hits) group by doc_id
)
select d.doc_id, len(d.words)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
       sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from doc_words d left join hit_words h on d.doc_id = h.doc_id left join hit_items i on d.doc_id = i.doc_id
"""


@register("op7_decontamination", _DECONTAM_SQL)
def op7_decontamination(spark, sf_dir):
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontam.find_contamination(docs, load(spark, sf_dir, "benchmark")).drop("text")
    hit = F.aggregate("hit_spans", F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["start"])
    return (found.withColumn("n_hit", hit)
            .select("doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
                    sha256_hex(F.array_join("items", ",")).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated")))


# ---- 8 urls

_URLS_SQL = f"""
with subjects(subject) as (values {", ".join(f"('{w}')" for w in urls.SUBJECTS)}), lures(lure) as (values {", ".join(f"('{w}')" for w in urls.LURES)}),
patterns as (
    select unnest(['casino', 'pills', 'free-bets', 'ads-track', 'spam-farm', 'adult']) as words union all select subject || '-' || lure from subjects, lures
    union all select lure || '-' || subject from subjects, lures
), """ + r"""rests as (
    select page_id, case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end as rest from pages
), parts as (
    select page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
           regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from rests
), rules(verdict, rule_host, rule_path) as (
    values ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')
), spam as (
    select distinct page_id from parts join patterns on regexp_matches(host || path, '(^|[.-])' || words || '[.-]')
), fits as (
    select page_id, rule_host || rule_path as rule, r.verdict, row_number() over (partition by page_id order by length(rule_host || rule_path) desc) as place
    from parts p join rules r on (p.host = r.rule_host or suffix(p.host, '.' || r.rule_host)) and prefix(p.path, r.rule_path)
)
select p.page_id, p.host, p.path, f.rule, coalesce(f.verdict, case when s.page_id is not null then 'block' else 'allow' end) as verdict
from parts p left join fits f on p.page_id = f.page_id and f.place = 1 left join spam s on p.page_id = s.page_id
"""


@register("op8_urls", _URLS_SQL)
def op8_urls(spark, sf_dir):
    return urls.judge_urls(load(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict")


# ---- 3 near-duplicates

_NEARDUP_SQL = r"""
with recursive doc_words as (
    select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x20\x09-\x0D]+') as words from documents
), shingles as (
    select distinct doc_id, array_to_string(list_slice(words, place, place + 4), ' ') as shingle
    from (select doc_id, words, unnest(range(1, greatest(len(words) - 5, 0) + 2)) as place from doc_words where len(words) > 0)
), sizes as (
    select doc_id, count(*) as n from shingles group by doc_id
), shared as (
    select a.doc_id as a, b.doc_id as b, count(*) as n
    from shingles a join shingles b on a.shingle = b.shingle and a.doc_id <> b.doc_id group by all
), links as (
    select a, b from shared s join sizes x on s.a = x.doc_id join sizes y on s.b = y.doc_id where 100 * s.n >= 75 * (x.n + y.n - s.n)
), reached as (
    select doc_id as a, doc_id as b from documents
    union
    select r.a, l.b from reached r join links l on r.b = l.a
)
select d.doc_id, coalesce(s.n, 0)::bigint as n_shingles, r.component_id, d.doc_id = r.component_id as kept
from documents d left join sizes s on d.doc_id = s.doc_id
join (select a, min(b) as component_id from reached group by a) r on d.doc_id = r.a
"""


@register("op3_neardup", _NEARDUP_SQL)
def op3_neardup(spark, sf_dir):
    return neardup.near_duplicates(load(spark, sf_dir, "documents").select("doc_id", "text"))


# ---- 9 quality

@register("op9_quality")
def op9_quality(spark, sf_dir):
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    path = shared_folder(spark, "statistics")
    quality.text_statistics(docs).write.parquet(path)
    stats = spark.read.parquet(path)
    held_out = F.coalesce(crc_mod(4) == 2, F.lit(False))
    model = quality.fit_quality(stats, load(spark, sf_dir, "labels"), ~held_out)
    return quality.score_quality(stats, model).select(
        "doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


# ---- 10 toxicity

def toxicity_scores(docs, labels):
    """Documents with held_out, score, toxic_spans and predicted; learned from the rows that are not held out."""
    held_out = F.coalesce(crc_mod(3) == 1, F.lit(False))
    field = toxicity.fit_toxicity(docs, labels, ~held_out)
    return (toxicity.score_toxicity(docs, field)
            .withColumn("held_out", held_out).withColumn("predicted", (F.col("score") >= 0.7).cast("int")))


def without_toxic(docs, labels):
    """The documents, whole and with their own columns untouched, that are not predicted to be toxic."""
    need = ["doc_id", "text"]
    return release(toxicity_scores(hold(docs, need), labels).filter("predicted = 0"), docs.columns, need)


@register("op10_toxicity")
def op10_toxicity(spark, sf_dir):
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    spans = F.transform("toxic_spans", lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string")))
    return toxicity_scores(docs, load(spark, sf_dir, "labels")).select(
        "doc_id", "held_out", "score", "predicted", F.array_join(spans, ",").alias("toxic_spans"))


# ---- 5 vectors

_VECTORS_SQL = """
with recursive sound as (
    select vec_id, label, embedding::double[] as v from embeddings
    where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
      and len(list_filter(embedding, lambda x: x <> 0)) > 0
), links as (
    select a.vec_id as a, b.vec_id as b from sound a join sound b on a.label = b.label and a.vec_id <> b.vec_id and len(a.v) = len(b.v)
    where list_dot_product(a.v, b.v) / sqrt(list_dot_product(a.v, a.v)) / sqrt(list_dot_product(b.v, b.v)) >= 0.93
), reached as (
    select vec_id as a, vec_id as b from embeddings
    union
    select r.a, l.b from reached r join links l on r.b = l.a
)
select e.vec_id, coalesce(n, 0)::bigint as n_links, component_id, e.vec_id = component_id as kept
from embeddings e left join (select a, count(*) as n from links group by a) c on e.vec_id = c.a
join (select a, min(b) as component_id from reached group by a) r on e.vec_id = r.a
"""


@register("op5_vectors", _VECTORS_SQL)
def op5_vectors(spark, sf_dir):
    return hnsw.near_vectors(load(spark, sf_dir, "embeddings"))


# ---- 11 fill in the middle

_FIM_SQL = r"""
with drawn as (
    select doc_id, coalesce(text, '') as text, sha256('1:' || doc_id) as h, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') as tokens from documents
), numbers as (
    select doc_id, text, tokens, len(tokens)::bigint as n, ('0x' || h[1:8])::bigint as h1, ('0x' || h[9:16])::bigint as h2,
           ('0x' || h[17:24])::bigint as h3, ('0x' || h[25:32])::bigint as h4 from drawn
), formed as (
    select *, least(h1 % (n + 1), h2 % (n + 1)) as a, greatest(h1 % (n + 1), h2 % (n + 1)) as b,
           case when text = '' or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>') or h3 % 100 >= 90 then 'plain'
                when h4 % 100 < 20 then 'spm' else 'psm' end as form from numbers
), cut as (
    select doc_id, n, form, text, array_to_string(tokens[1:a], '') as p, array_to_string(tokens[a + 1:b], '') as m,
           array_to_string(tokens[b + 1:], '') as s from formed
)
select doc_id, n, form, case when form <> 'plain' then length(p) end as prefix_chars, case when form <> 'plain' then length(m) end as middle_chars,
       sha256(case form when 'plain' then text when 'psm' then '<P>' || p || '<S>' || s || '<M>' || m
              else '<S>' || s || '<P>' || p || '<M>' || m end) as output_sha256, sha256(text) as restored_sha256
from cut
"""


@register("op11_fill_in_middle", _FIM_SQL)
def op11_fill_in_middle(spark, sf_dir):
    made = fim.fill_in_middle(load(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha256_hex(F.col("output")).alias("output_sha256"),
                       sha256_hex(fim.restore()).alias("restored_sha256"))


# ---- 13 centroid clustering

def _clusters_sql():
    """Five unrolled rounds over (vector, dimension, integer) rows."""
    steps = ["""kept as materialized (
    select vec_id, sha256('2:' || vec_id) as h, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as v from embeddings
    where embedding is not null and len(embedding) = 64 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), cells as materialized (select vec_id, unnest(range(1, 65)) as d, unnest(v) as x from kept),
firsts as (select row_number() over (order by h) - 1 as c, v from kept order by h limit 40),
m0 as materialized (select c, unnest(range(1, 65)) as d, unnest(v) as x from firsts)"""]
    for i in range(6):
        steps.append(f"""far{i} as materialized (
    select vec_id, c, sum((p.x - m.x) * (p.x - m.x))::bigint as distance from cells p join m{i} m on p.d = m.d group by all
), at{i} as materialized (select vec_id, arg_min(c, (distance, c)) as c, min(distance) as distance from far{i} group by vec_id)""")
        if i < 5:
            steps.append(f"""s{i} as (select c, d, sum(x)::bigint as s, count(*)::bigint as n from cells join at{i} using (vec_id) group by all),
m{i + 1} as materialized (
    select m.c, m.d, case when n is null then m.x else (s - ((s % n) + n) % n) // n end as x from m{i} m left join s{i} s on m.c = s.c and m.d = s.d
)""")
    return "with " + ",\n".join(steps) + """,
hashed as (select c, sha256(string_agg(x::varchar, ',' order by d)) as centroid_sha256 from m5 group by c)
select vec_id, c::int as cluster, distance, (sum(distance) over (partition by c))::bigint as cluster_inertia,
       (sum(distance) over ())::bigint as inertia, centroid_sha256
from at5 join hashed using (c)
"""


@register("op13_centroids", _clusters_sql())
def op13_centroids(spark, sf_dir):
    assigned, centroids = lookup.cluster_vectors(load(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    return lookup.with_inertia(assigned, centroids).select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


# ---- 12 document fingerprints

# bytes as two hex digits each; a triplet is its three places in the window of five
_DIGEST_SQL = f"""
with ordered as (
    select doc_id, coalesce(text, '') as text, coalesce(lead(coalesce(text, '')) over (order by doc_id), first_value(coalesce(text, '')) over (order by doc_id)) as after
    from documents
), edits as materialized (
    select doc_id, text, left(text, (length(text) - length(text) // 4)::bigint) || left(after, (length(text) // 4)::bigint) as edited from ordered
), texts as (
    select doc_id, 0 as which, text from edits union all select doc_id, 1, edited from edits
), bytes as materialized (
    select doc_id, which, strlen(text) as size, list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda d: ('0x' || d)::bigint) as b from texts
), places as (
    select doc_id, which, b, unnest(range(1, size - 1)) as p from bytes
), triplets as (
    select doc_id, which, unnest(list_filter([{", ".join(f"{shape << 24} + b[p + {i}] * 65536 + b[p + {j}] * 256 + b[p + {k}]" for shape, (i, j, k) in enumerate(digest.TRIPLETS))}],
           lambda v: v is not null)) as v from places
), counted as (
    select doc_id, which, (v * {digest.MULTIPLIER} % 4294967296) // 16777216 as bucket, count(*) as n from triplets group by all
), filled as (
    select t.doc_id, t.which, t.bucket, coalesce(n, 0) as n from (select doc_id, which, unnest(range({digest.BUCKETS})) as bucket from bytes) t
    left join counted c on t.doc_id = c.doc_id and t.which = c.which and t.bucket = c.bucket
), sorted as (
    select doc_id, which, list_sort(list(n)) as s, list(n order by bucket) as n from filled group by all
), coded as (
    select doc_id, which, list_transform(n, lambda x: (x > s[{digest.BUCKETS // 4}])::int + (x > s[{digest.BUCKETS // 2}])::int + (x > s[{3 * digest.BUCKETS // 4}])::int) as code from sorted
), sized as (
    select doc_id, which, code, case when size = 0 then 0 when size < 4 then 4 * length(bin(size)) else 4 * length(bin(size)) + ('0b' || substr(bin(size), 2, 2))::bigint end as lc
    from coded join bytes using (doc_id, which)
), prints as materialized (
    select doc_id, which, code, lc, lower(printf('%02x', lc) || array_to_string(list_transform(range(1, {digest.BUCKETS}, 2), lambda i: printf('%x', code[i] * 4 + code[i + 1])), '')) as print,
           list_sum(list_transform(code, lambda c: [0, 1, 2, 6][c + 1])) as weight
    from sized
), pairs as (
    select a.doc_id, 0 as what, a as l, b as r from prints a join prints b on a.doc_id = b.doc_id and a.which = 0 and b.which = 1
    union all
    select a.doc_id, 1, a, b from (select doc_id, coalesce(lead(doc_id) over (order by doc_id), first_value(doc_id) over (order by doc_id)) as after from edits) n
    join prints a on n.doc_id = a.doc_id and a.which = 0 join prints b on n.after = b.doc_id and b.which = 0
), scored as (
    select doc_id, what, (list_sum(list_transform(range(1, {digest.BUCKETS + 1}), lambda i: [0, 1, 2, 6][abs(l.code[i] - r.code[i]) + 1]))
           + {digest.STEP_WEIGHT} * greatest(0, least({digest.LENGTH_STEPS}, abs(l.lc - r.lc) - 1)))::bigint as difference,
           least({digest.BOUND}, l.weight + r.weight)::bigint as bound from pairs
), likeness as (
    select doc_id, what, case when difference = 0 then 1.0::double when bound = 0 then 0.0::double
           else 1.0::double - least(difference, bound)::double / bound::double end as likeness from scored
)
select e.doc_id, length(e.text)::bigint as n_chars, sha256(e.edited) as edited_sha256, a.print as fingerprint, b.print as edited_fingerprint,
       x.likeness as near_edited, y.likeness as near_next
from edits e join prints a on e.doc_id = a.doc_id and a.which = 0 join prints b on e.doc_id = b.doc_id and b.which = 1
join likeness x on e.doc_id = x.doc_id and x.what = 0 join likeness y on e.doc_id = y.doc_id and y.what = 1
"""


@register("op12_fingerprints", _DIGEST_SQL)
def op12_fingerprints(spark, sf_dir):
    return digest.edit_by_next(load(spark, sf_dir, "documents").select("doc_id", "text"))
