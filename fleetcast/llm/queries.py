"""The registered queries of this package: each applies one operator to its whole table with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetcast.llm.centroids import cluster_vectors
from fleetcast.llm.exact_topk import exact_topk
from fleetcast.llm.hamming_index import nearest_by_codes
from fleetcast.llm.hard_negatives import hard_negatives
from fleetcast.llm.licenses import PARAGRAPH, TEMPLATES, scan_licenses
from fleetcast.llm.line_dedup import dedup_lines
from fleetcast.llm.mixing import mix_sources
from fleetcast.llm.packing import pack_documents
from fleetcast.llm.parity_join import jaccard_groups
from fleetcast.llm.revisits import resolve_revisits
from fleetcast.llm.suffix_dedup import dedup_suffixes
from fleetcast.llm.toxicity import learn_toxicity, score_toxicity
from fleetcast.llm.url_filters import judge_urls

#: The fixed rules of the URL filter query: host, path, verdict.
URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]

#: Target weights of the mixture; sources not named here share the smallest.
SOURCE_WEIGHTS = {"src0": 0.2, "src1": 0.1, "src2": 0.1, "src3": 0.05, "src4": 0.05}
#: Scores from here on count as toxic.
TOXIC_FROM = 0.3


def held_out(id_col: str) -> Column:
    """Rows from which no label is learned."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2


def op1_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_topk(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 100 == 0).drop("scored")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "text", F.array_join("deleted_lines", ",").alias("deleted_lines"))


def capture_records(pages: DataFrame) -> DataFrame:
    """Pages as WARC records: each is fetched three times, a day and some minutes apart, and later fetches may be revisits.

    The second fetch of two pages in three, and the third of every page, is a revisit; every fifth page changed before the
    third, so that its validators differ. Entity tags and dates go missing for some pages.
    """
    visits = pages.select("page_id", "url", F.md5("html").alias("digest"), F.explode(F.sequence(F.lit(0), F.lit(2))).alias("visit"))
    seconds = F.lit(1_700_000_000) + F.col("page_id") * 60 + F.col("visit") * 90_000
    again = ((F.col("visit") == 1) & (F.col("page_id") % 3 != 0)) | (F.col("visit") == 2)
    changed = (F.col("visit") == 2) & (F.col("page_id") % 5 == 0)
    tag = F.when(F.col("page_id") % 7 != 0, F.concat(F.when(again, F.lit('W/"')).otherwise('"'), F.substring("digest", 1, 8), F.when(changed, "x").otherwise(""), F.lit('"')))
    date = F.when(F.col("page_id") % 11 != 0, F.concat(F.lit("d"), F.when(changed, F.col("page_id") + 1).otherwise(F.col("page_id"))))
    pairs = [("etag", tag), ("last-modified", date), ("content-type", F.lit("text/html")), ("date", F.concat(F.lit("t"), "visit")), ("content-length", F.when(again, "0").otherwise("9"))]
    headers = F.map_filter(F.map_from_arrays(F.array(*[F.lit(k) for k, _ in pairs]), F.array(*[v for _, v in pairs])), lambda k, v: v.isNotNull())
    return visits.select(
        (F.col("page_id") * 3 + F.col("visit")).alias("record_id"),
        "url",
        F.timestamp_seconds(seconds).alias("time"),
        F.when(again, "revisit").otherwise("response").alias("type"),
        F.when(again, 304).otherwise(200).alias("status"),
        headers.alias("headers"),
        F.when(~again, F.col("digest")).alias("payload_digest"),
    )


def op3_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = resolve_revisits(capture_records(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")))
    names = ["etag", "last-modified", "content-type", "date", "content-length"]
    merged = [F.col("headers")[n].alias(n.replace("-", "_")) for n in names]
    return found.select("record_id", "canonical_url", F.unix_seconds("time").alias("seconds"), "refers_to", "outcome", *merged)


def op4_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return judge_urls(pages, spark.createDataFrame(URL_RULES, "host string, path string, verdict string")).drop("url")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    machine = learn_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), ~held_out("doc_id"))
    scored = score_toxicity(docs, machine)
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= TOXIC_FROM).cast("int").alias("predicted"))


def op7_hamming_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_by_codes(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 100 == 0)


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source")
    return mix_sources(docs, SOURCE_WEIGHTS)


def op9_parity_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"), shingle=4, num=85, den=100)


#: Documents as files of a tree: sources hold directories of three depths, and every fifth document is named as a license file.
FILE_PATH = """concat(coalesce(source, 'none'), case when doc_id % 3 >= 1 then concat('/m', doc_id % 50) else '' end, case when doc_id % 3 = 2 then concat('/s', doc_id % 7) else '' end,
    case when doc_id % 5 = 0 then '/LICENSE-' else '/f' end, doc_id, '.txt')"""


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", F.expr(FILE_PATH).alias("path"))
    # The scan reads the texts; what it is joined to needs none.
    return scan_licenses(files).drop("text")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 100 == 0, label)


def op12_run_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dedup_suffixes(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    removed = F.aggregate("removed_spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select(
        "doc_id",
        F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"),
        removed.alias("n_removed"),
        F.size("removed_spans").cast("long").alias("n_spans"),
        F.sha2(F.coalesce("kept", F.lit(b"")), 256).alias("kept_sha256"),
    )


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet")).drop("centroid")


#: Rounds of the clustering query as SQL: all vectors are assigned, then centroids move.
def _cluster_sql(rounds: int = 3) -> str:
    steps = []
    for i in range(rounds + 1):
        steps.append(f"""a{i} as (select vec_id, min(d) as distance, cast(arg_min(c.cluster, d * 64 + c.cluster) as integer) as cluster
            from (select e.vec_id, c.cluster, cast(list_sum(list_transform(list_zip(e.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) as bigint) as d from e cross join c{i} c) c group by vec_id)""")
        if i < rounds:
            steps.append(f"""s{i} as (select a.cluster, p.i, sum(e.v[p.i]) as s, count(*) as n from a{i} a join e on e.vec_id = a.vec_id cross join p group by 1, 2),
            m{i} as (select cluster, list(cast((s - ((s % n) + n) % n) // n as bigint) order by i) as v from s{i} group by 1),
            c{i + 1} as (select c.cluster, coalesce(m.v, c.v) as v from c{i} c left join m{i} m on m.cluster = c.cluster)""")
    return f"""
        with e as (select vec_id, list_transform(embedding, lambda x: cast(floor(64 * cast(x as double)) as bigint)) as v from embeddings
                   where len(embedding) = 64 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
        p as (select unnest(range(1, 65)) as i),
        h as (select v, sha256(concat('1:', vec_id)) as h from e),
        c0 as (select cast(row_number() over (order by h) - 1 as integer) as cluster, v from (select * from h order by h limit 16)),
        {", ".join(steps)},
        t as (select cluster, cast(sum(distance) as bigint) as cluster_inertia from a{rounds} group by 1)
        select a.vec_id, a.cluster, a.distance, t.cluster_inertia, cast((select sum(distance) from a{rounds}) as bigint) as inertia, sha256(array_to_string(c.v, ',')) as centroid_sha256
        from a{rounds} a join t on t.cluster = a.cluster join c{rounds} c on c.cluster = a.cluster
    """


QUERIES = {
    "op1_exact_topk": op1_exact_topk,
    "op2_line_dedup": op2_line_dedup,
    "op3_revisits": op3_revisits,
    "op4_url_filters": op4_url_filters,
    "op5_packing": op5_packing,
    "op6_toxicity": op6_toxicity,
    "op7_hamming_index": op7_hamming_index,
    "op8_mixing": op8_mixing,
    "op9_parity_join": op9_parity_join,
    "op10_licenses": op10_licenses,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_run_index": op12_run_index,
    "op13_centroids": op13_centroids,
}

ORACLES = {
    "op1_exact_topk": """
        with e as (select vec_id, list_transform(embedding, lambda x: floor(1024 * cast(x as double))) as v
                   from embeddings where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
        s as (select q.vec_id as query_id, c.vec_id, cast(list_inner_product(q.v, c.v) as bigint) as score
              from e q join e c on q.vec_id % 100 = 0 and c.vec_id <> q.vec_id),
        r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as n from s)
        select query_id, cast(n as integer) as rank, vec_id, score from r where n <= 10
    """,
    "op2_line_dedup": r"""
        with l as (select doc_id, unnest(string_split(text, chr(10))) as raw, generate_subscripts(string_split(text, chr(10)), 1) - 1 as line from documents),
        t as (select doc_id, line, raw, trim(raw, ' ' || chr(9) || chr(13)) as t from l),
        n as (select *, row_number() over (partition by doc_id order by line) as idx, len(string_split_regex(t, '[ \t\r]+')) as words from t where t <> ''),
        c as (select *, sum(words) over (partition by doc_id order by idx) as after from n),
        r as (select x.doc_id, x.idx as lo, min(y.idx) as hi from c x join c y on x.doc_id = y.doc_id and y.idx >= x.idx and y.after - x.after + x.words >= 50 and y.idx < x.idx + 50 group by 1, 2
              union select x.doc_id, max(y.idx), x.idx from c x join c y on x.doc_id = y.doc_id and y.idx <= x.idx and x.after - y.after + y.words >= 50 and y.idx > x.idx - 50 group by 1, x.idx),
        k as (select r.doc_id, lo, hi, string_agg(n.t, chr(10) order by n.idx) as run from r join n on n.doc_id = r.doc_id and n.idx between lo and hi group by 1, 2, 3),
        d as (select *, row_number() over (partition by run order by doc_id, lo) as copy from k),
        g as (select distinct n.doc_id, n.line from d join n on d.doc_id = n.doc_id and n.idx between lo and hi where copy > 1),
        a as (select t.doc_id, string_agg(t.raw, chr(10) order by t.line) filter (where g.line is null) as text, string_agg(cast(g.line as varchar), ',' order by t.line) as deleted_lines
              from t left join g on t.doc_id = g.doc_id and t.line = g.line group by 1)
        select x.doc_id, case when x.text is null then null else coalesce(a.text, '') end as text, coalesce(a.deleted_lines, '') as deleted_lines
        from documents x left join a on a.doc_id = x.doc_id
    """,
    "op3_revisits": r"""
        with v as (select page_id, url, md5(html) as digest, unnest([0, 1, 2]) as visit from pages),
        p as (select *, (visit = 1 and page_id % 3 <> 0) or visit = 2 as again, visit = 2 and page_id % 5 = 0 as changed,
                regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://(?:[^/?#@]*@)?([^/?#]*)([^?#]*)(?:\?([^#]*))?', ['s', 'h', 'p', 'q']) as u from v),
        c as (select *, regexp_replace(regexp_replace(concat('&', u.q), '&(utm_[^=&]*|gclid|fbclid|ref)(=[^&]*)?(&|$)', '\3', 'g'), '^&+', '') as query from p),
        r as (select page_id * 3 + visit as record_id, 1700000000 + page_id * 60 + visit * 90000 as seconds, again, digest,
                concat(lower(u.s), '://', regexp_replace(lower(u.h), '\.?(:(80|443)?)?$', ''), case when u.p = '' then '/' else u.p end, case when query = '' then '' else concat('?', query) end) as canonical_url,
                case when page_id % 7 <> 0 then concat('"', substr(digest, 1, 8), case when changed then 'x' else '' end, '"') end as tag,
                case when page_id % 11 <> 0 then concat('d', case when changed then page_id + 1 else page_id end) end as modified, visit from c),
        j as (select x.record_id, x.canonical_url, x.seconds, x.tag, x.modified, x.visit, y.record_id as refers_to, y.tag as old_tag, y.modified as old_modified,
                row_number() over (partition by x.record_id order by y.seconds desc, y.record_id desc) as k
              from r x left join r y on x.canonical_url = y.canonical_url and not y.again and y.seconds < x.seconds where x.again),
        o as (select *, case when refers_to is null then 'unresolved' when coalesce(tag = old_tag, modified = old_modified) is null then 'unchecked'
                when coalesce(tag = old_tag, modified = old_modified) then 'matched' else 'mismatch' end as outcome from j where k = 1)
        select record_id, canonical_url, seconds, refers_to, outcome,
               case when outcome in ('matched', 'unchecked') then coalesce('W/' || tag, old_tag) end as etag,
               case when outcome in ('matched', 'unchecked') then coalesce(modified, old_modified) end as last_modified,
               case when outcome in ('matched', 'unchecked') then 'text/html' end as content_type,
               case when outcome in ('matched', 'unchecked') then concat('t', visit) end as date,
               case when outcome in ('matched', 'unchecked') then '9' end as content_length
        from o
    """,
    "op4_url_filters": """
        with u as (select page_id,
                     case when strpos(url, '://') > 0 then translate(regexp_extract(substr(url, strpos(url, '://') + 3), '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') else '' end as host,
                     case when strpos(url, '://') > 0 then regexp_extract(substr(url, strpos(url, '://') + 3), '^[^/?#]*([^?#]*)', 1) else '' end as path
                   from pages),
        r as (select page_id, host, path, case
                when (host = 'example.net' or host like '%.example.net') and path like '/en/%' then 'example.net/en/'
                when (host = 'example.com' or host like '%.example.com') and path like '/de/%' then 'example.com/de/'
                when (host = 'org' or host like '%.org') and path like '/fr/%' then 'org/fr/'
                when (host = 'net' or host like '%.net') and path like '/%' then 'net/' end as rule from u)
        select *, case when rule in ('net/', 'example.com/de/') then 'block' else 'allow' end as verdict from r
    """,
    "op9_parity_join": r"""
        with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
        s as (select doc_id, case when len(w) = 0 then [] when len(w) < 4 then [array_to_string(w, ' ')]
                else list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) end as s from w),
        n as (select doc_id, len(s) as n from s),
        e as (select doc_id, unnest(s) as t from s),
        p as (select x.doc_id as a, y.doc_id as b, count(*) as c from e x join e y on x.t = y.t and x.doc_id < y.doc_id group by 1, 2),
        l as (select a, b from p join n x on a = x.doc_id join n y on b = y.doc_id where 100 * c >= 85 * (x.n + y.n - c)),
        u as (select a, b from l union select b, a from l),
        r(doc_id, c) as (select doc_id, doc_id from n union select u.b, r.c from r join u on u.a = r.doc_id)
        select n.doc_id, cast(n.n as bigint) as n_shingles, min(r.c) as component_id from n join r on r.doc_id = n.doc_id group by n.doc_id, n.n
    """,
    "op10_licenses": rf"""
        with f as (select doc_id, text, {FILE_PATH} as path from documents),
        t(template, license, text) as (values {", ".join(f"({i}, '{n}', '{t}')" for i, (n, t) in enumerate(TEMPLATES))}),
        tw as (select template, license, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) as word from t),
        v as (select template, license, word, count(*) as n from tw group by 1, 2, 3),
        fw as (select distinct path, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) as word from f where text is not null),
        dfs as (select word, count(*) as c from fw where word in (select word from v) group by 1),
        size as (select count(*) as total from f where text is not null),
        idf as (select distinct v.word, ln((total + 1) / (coalesce(c, 0) + 1)) + 1 as idf from v cross join size left join dfs on dfs.word = v.word),
        tv as (select template, license, v.word, n * idf as weight from v join idf on idf.word = v.word),
        norms as (select template, sqrt(sum(weight * weight)) as norm from tv group by 1),
        u as (select distinct path, unnest(list_concat([text], string_split_regex(text, '{PARAGRAPH}'), string_split(text, chr(10)))) as unit from f where text is not null),
        ut as (select path, unit, unnest(regexp_extract_all(lower(unit), '[a-z0-9]+')) as word from u),
        tf as (select path, unit, case when idf is not null then ut.word end as word, idf, count(*) as n from ut left join idf on idf.word = ut.word group by 1, 2, 3, 4),
        lengths as (select path, unit, sqrt(sum(case when word is null then n * pow(ln(total + 1) + 1, 2) else pow(n * idf, 2) end)) as length from tf cross join size group by 1, 2),
        s as (select tf.path, tf.unit, tv.template, tv.license, round(sum(tf.n * tf.idf * tv.weight) / any_value(length) / any_value(norm), 6) as score
              from tf join tv on tv.word = tf.word join lengths l on l.path = tf.path and l.unit = tf.unit join norms on norms.template = tv.template group by 1, 2, 3, 4),
        b as (select *, row_number() over (partition by path order by score desc, license) as k from s where score >= 0.7),
        own as (select path, license, score, case when strpos(path, '/') > 0 then regexp_replace(path, '/[^/]*$', '') else '' end as dir from b where k = 1),
        d as (select dir, license, row_number() over (partition by dir order by score desc, path) as k from own where regexp_matches(path, '/LICENSE-')),
        g as (select *, regexp_replace(path, '/[^/]*$', '') as dir from f),
        a as (select g.doc_id, d.dir, d.license, row_number() over (partition by g.doc_id order by length(d.dir) desc) as k
              from g join d on d.k = 1 and (g.dir = d.dir or starts_with(g.dir, concat(d.dir, '/'))))
        select g.doc_id, g.path, coalesce(own.license, a.license) as license, own.score as license_score,
               case when own.license is not null then 'own' when a.license is not null then 'inherited' else 'none' end as license_from,
               case when own.license is null then a.dir end as license_dir
        from g left join own on own.path = g.path left join a on a.doc_id = g.doc_id and a.k = 1
    """,
    "op11_hard_negatives": """
        with e as (select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor(256 * cast(x as double))) as v
                   from embeddings where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
        s as (select q.vec_id as anchor_id, c.vec_id, q.label = c.label as same, cast(list_inner_product(q.v, c.v) as bigint) as score
              from e q join e c on q.vec_id % 100 = 0 and c.vec_id <> q.vec_id),
        p as (select anchor_id, vec_id as positive_id, score as positive_score, row_number() over (partition by anchor_id order by score desc, vec_id) as k from s where same),
        n as (select p.anchor_id, positive_id, positive_score, vec_id as negative_id, score as negative_score,
                row_number() over (partition by p.anchor_id, positive_id order by score desc, vec_id) as n
              from p join s on s.anchor_id = p.anchor_id and not s.same and 30 * positive_score <= 100 * score and 100 * score <= 90 * positive_score where k <= 5)
        select anchor_id, positive_id, cast(n as integer) as rank, negative_id, positive_score, negative_score from n where n <= 10
    """,
    "op12_run_index": """
        with t as (select doc_id, hex(encode(coalesce(text, ''))) as h, octet_length(encode(coalesce(text, ''))) as n from documents),
        o as (select doc_id, h, n, unnest(range(0, n - 199, 100)) as o from t where n >= 200),
        q as (select doc_id, n, o, substr(h, 2 * o + 1, 600) as h from o),
        p as (select doc_id, o, h, unnest(range(0, least(100, n - 199 - o))) as k from q),
        w as (select doc_id, o + k as i, md5(substr(h, 2 * k + 1, 400)) as m from p),
        r as (select doc_id, i from w where m in (select m from w group by m having count(*) > 1)),
        b as (select *, coalesce(i - lag(i) over (partition by doc_id order by i) > 200, true) as new from r),
        g as (select *, sum(cast(new as integer)) over (partition by doc_id order by i) as k from b),
        s as (select doc_id, min(i) as lo, max(i) + 200 as hi from g group by doc_id, k),
        e as (select doc_id, lo, coalesce(lag(hi) over (partition by doc_id order by lo), 0) as past from s union all select doc_id, n, coalesce(hi, 0) from t left join (select doc_id, max(hi) as hi from s group by 1) using (doc_id)),
        k as (select e.doc_id, string_agg(substr(h, 2 * past + 1, 2 * (lo - past)), '' order by lo) as kept from e join t using (doc_id) group by 1),
        c as (select doc_id, sum(hi - lo) as removed, count(*) as spans from s group by 1)
        select t.doc_id, cast(n as bigint) as n_bytes, cast(coalesce(removed, 0) as bigint) as n_removed, coalesce(spans, 0) as n_spans, sha256(unhex(kept)) as kept_sha256
        from t join k using (doc_id) left join c using (doc_id)
    """,
    "op13_centroids": _cluster_sql(),
}
