"""The operators as queries over whole tables, and their SQL where there is one."""

from __future__ import annotations

import hashlib

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import centroids, chat, decontaminate, language, line_dedup, mixing, near_embeddings, ngram_join, periodic_runs, quality, sentencepiece_codec, toxicity, url_filters
from tidemark.llm.common import held_out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: (verdict, host, path)
URL_RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]
#: Hosts with one of these in their names make up the block list.
URL_TERMS = ("spam", "pills", "casino")


#: File of the tokenizer.
PIECE_MODEL = public_tokenizers.path("piece_bpe_32k.model")
#: Words of a test string of a benchmark.
WINDOW = 13


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.octet_length("text").alias("n_bytes"), "text")
    coded = sentencepiece_codec.encode_frame(docs, PIECE_MODEL, keep_text=False)
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
        (F.coalesce(F.try_element_at("ends", F.lit(-1)), F.lit(0)) == F.coalesce("n_bytes", F.lit(0))).alias("spans_cover_text"),
    )


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = decontaminate.find_overlap(docs, table(spark, sf_dir, "benchmark"), WINDOW, keep_text=False)
    return out.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        decontaminate.contaminated(F.col("n_words"), F.col("n_hit")).alias("contaminated"),
    )


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels").filter(~held_out()))
    out = toxicity.score(docs, model, keep_text=False)
    return out.select("doc_id", held_out().alias("held_out"), "severity", "score", "grade", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language.fit(docs.filter(~held_out()))
    out = language.predict(docs.select("doc_id", "text"), model, keep_text=False)
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def quality_model(spark: SparkSession, sf_dir: str) -> quality.AdditiveModel:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.fit(docs, table(spark, sf_dir, "labels").filter(~held_out()))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = quality.score(docs, quality_model(spark, sf_dir), keep_text=False)
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op6_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = r"\### Assistant: </turn> ok"
    added = spark.sql("select * from values (-7L, 0L, 'user', :t), (-7L, 1L, 'assistant', :t) as v(conv_id, turn, role, text)", args={"t": both})
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(added)
    back = chat.read_back(chat.format_windows(rows))
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(turns, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss"), 256).alias("loss_sha256"),
        "formatted_chars",
        "n_windows",
    )


def op7_url_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    out = url_filters.filter_urls(pages, url_filters.hosts_named(pages, URL_TERMS), URL_RULES)
    return out.select("page_id", "host", "path", "rule", "verdict")


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.dedup_lines(docs).select("doc_id", "text", "n_lines", "n_dropped")


def op8_line_dedup_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As op8, and repeats of shorter lines go too."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.dedup_lines(docs, min_repeat=1).select("doc_id", "text", "n_lines", "n_dropped")


def op9_near_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_embeddings.near_vectors(table(spark, sf_dir, "embeddings"), least=0.93)


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_components(table(spark, sf_dir, "documents").select("doc_id", "text"), n=5, percent=75)


def with_repeats(docs: DataFrame) -> DataFrame:
    """Documents of which those whose h = crc32(decimal doc_id) is divisible by 10 repeat a
    period p from word a to their end: word i becomes word a + (i - a) % p."""
    h, words = F.crc32(F.col("doc_id").cast("string").cast("binary")), F.regexp_extract_all("text", F.lit(r"([^\x20\x09-\x0D]+)"), 1)
    rows = docs.withColumn("words", F.when(h % 10 == 0, words)).withColumns({"g": F.floor(h / 10), "n": F.size("words").cast("long")})
    rows = rows.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n"))).withColumn("p", 1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8)))
    place = lambda i: F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p"))
    again = F.transform(F.sequence(F.lit(0).cast("long"), F.col("n") - 1), lambda i: F.get("words", place(i).cast("int")))
    return rows.withColumn("text", F.when(F.col("n") > 0, F.array_join(again, " ")).otherwise(F.col("text"))).drop("words", "g", "n", "a", "p")


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = with_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    out = periodic_runs.find_runs(docs, keep_text=False)
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", *[r[c].cast("string") for c in ("start", "length", "period")]), F.lit("\n"))), "")
    return out.withColumn("best", best).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("best.start")).alias("start"),
        F.col("best.length").alias("length"),
        (-F.col("best.period")).alias("period"),
        F.floor(1000 * F.col("best.length") / -F.col("best.period")).cast("long").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed"), 256).alias("collapsed_sha256"),
    )


def op12_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source")).taken()


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    near, final = centroids.cluster(table(spark, sf_dir, "embeddings"))
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in final.tolist()]
    digest = F.element_at(F.array(*map(F.lit, digests)), F.col("cluster") + 1) if digests else F.lit("")
    return near.withColumn("centroid_sha256", digest)


QUERIES = {
    "op1_sentencepiece": op1_sentencepiece,
    "op2_toxicity": op2_toxicity,
    "op3_decontaminate": op3_decontaminate,
    "op4_language": op4_language,
    "op5_quality": op5_quality,
    "op6_chat_windows": op6_chat_windows,
    "op7_url_cascade": op7_url_cascade,
    "op8_line_dedup": op8_line_dedup,
    "op8_line_dedup_whole": op8_line_dedup_whole,
    "op9_near_embeddings": op9_near_embeddings,
    "op10_ngram_join": op10_ngram_join,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_source_mix": op12_source_mix,
    "op13_centroids": op13_centroids,
}

_OP7_FITS = " ".join(
    f"when (host = '{h}' or ends_with(host, '.{h}')) and starts_with(path, '{p}') then '{v}:{h}{p}'" for v, h, p in sorted(URL_RULES, key=lambda r: -len(r[1] + r[2]))
)
_OP7_LISTED = " or ".join(f"contains(host, '{t}')" for t in URL_TERMS)

_WORDS = r"regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

def _op13_sql(k: int = 16, rounds: int = 3) -> str:
    """The rounds one by one: nearest centroids (ties: the smaller number), then floors of the means."""
    apart = "list_sum(list_transform(list_zip(v, c), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"
    out = f"""
        with kept as (select vec_id, list_transform(embedding, lambda x: cast(floor(64 * cast(x as double)) as bigint)) as v from embeddings
                      where len(embedding) = 64 and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = 64),
        c0 as (select row_number() over (order by sha256('1:' || vec_id), v) - 1 as cluster, v as c from kept qualify cluster < {k})"""
    for r in range(rounds + 1):
        out += f""",
        a{r} as (select vec_id, v, cluster, {apart} as distance from kept, c{r} qualify row_number() over (partition by vec_id order by distance, cluster) = 1)"""
        if r < rounds:
            out += f""",
        m{r} as (select cluster, list(cast(floor(s / n) as bigint) order by i) as c
                 from (select cluster, i, sum(x) as s, count(*) as n from (select cluster, unnest(v) as x, generate_subscripts(v, 1) as i from a{r}) group by all) group by cluster),
        c{r + 1} as (select c{r}.cluster, coalesce(m{r}.c, c{r}.c) as c from c{r} left join m{r} using (cluster))"""
    return out + f"""
        select vec_id, cast(cluster as int) as cluster, cast(distance as bigint) as distance, cast(sum(distance) over (partition by cluster) as bigint) as cluster_inertia,
               cast(sum(distance) over () as bigint) as inertia, sha256(array_to_string(c, ',')) as centroid_sha256
        from a{rounds} join c{rounds} using (cluster)"""


ORACLE = {
    "op3_decontaminate": f"""
        with d as (select doc_id, coalesce({_WORDS.format("text")}, []) as w from documents),
        b as (select cast(item_id as varchar) as item, {_WORDS.format("text")} as w from benchmark),
        bl as (select item, w, least(len(w), {WINDOW}) as m from b where len(w) > 0),
        pat as (select distinct item, m, array_to_string(w[i:i + m - 1], ' ') as k from (select item, w, m, unnest(range(1, len(w) - m + 2)) as i from bl)),
        ms as (select distinct m from pat),
        win as (select doc_id, m, i, array_to_string(w[i:i + m - 1], ' ') as k
                from (select doc_id, w, m, unnest(range(1, len(w) - m + 2)) as i from d, ms where len(w) >= m)),
        occ as (select doc_id, item, win.m as m, i from win join pat on win.m = pat.m and win.k = pat.k),
        hit as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + m)) as p from occ) group by doc_id),
        its as (select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as items from (select distinct doc_id, item from occ) group by doc_id)
        select d.doc_id, len(w) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(items, '')) as items_sha256,
               coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
        from d left join hit using (doc_id) left join its using (doc_id)
    """,
    "op7_url_cascade": f"""
        with a as (select page_id, case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) else '' end as rest from pages),
        h as (select page_id, rest, regexp_extract(rest, '^[^/?#]*') as raw from a),
        s as (select page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
                     regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') as path from h),
        r as (select *, case {_OP7_FITS} end as hit from s)
        select page_id, host, path, nullif(substr(hit, instr(hit, ':') + 1), '') as rule,
               coalesce(split_part(hit, ':', 1), case when {_OP7_LISTED} then 'block' else 'allow' end) as verdict
        from r
    """,
    "op8_line_dedup": f"""
        with l as (select doc_id, i, line, lower(trim(line)) as x
                   from (select doc_id, unnest(str_split(text, chr(10))) as line, generate_subscripts(str_split(text, chr(10)), 1) as i from documents where text is not null)),
        d as (select x, length(x) as n, min((doc_id, i)) as f from l where length(x) >= {line_dedup.MIN_CHARS} group by x),
        k as (select x, n, f, n - o as m, o, unnest([0, 1]) as s from (select *, unnest([0, 1]) as o from d)),
        h as (select *, case when s = 0 then right(x, m - m // 2) else left(x, m // 2) end as part from k),
        p as (select distinct a.x as x, b.x as y from h a join h b on a.m = b.m and a.s = b.s and a.part = b.part and a.o + b.o < 2 and b.f < a.f),
        near as (select distinct x from p where
            (length(x) = length(y) and len(list_filter(range(length(x)), lambda q: left(x, q) = left(y, q) and substr(x, q + 2) = substr(y, q + 2))) > 0)
            or (length(x) = length(y) + 1 and len(list_filter(range(length(x)), lambda q: left(x, q) = left(y, q) and substr(x, q + 2) = substr(y, q + 1))) > 0)
            or (length(y) = length(x) + 1 and len(list_filter(range(length(y)), lambda q: left(y, q) = left(x, q) and substr(y, q + 2) = substr(x, q + 1))) > 0)),
        g as (select l.*, d.x is not null and (near.x is not null or (l.doc_id, l.i) != d.f) as gone from l left join d on l.x = d.x left join near on l.x = near.x),
        r as (select doc_id, string_agg(line, chr(10) order by i) filter (not gone) as t, count(*) as n_lines, count(*) filter (gone) as n_dropped from g group by doc_id)
        select doc_id, case when documents.text is null then null else coalesce(t, '') end as text, coalesce(n_lines, 0) as n_lines, coalesce(n_dropped, 0) as n_dropped
        from documents left join r using (doc_id)
    """,
    "op9_near_embeddings": """
        with v as (select vec_id, label, cast(embedding as double[]) as e from embeddings),
        p as (select a.vec_id as a, b.vec_id as b from v a join v b on a.label = b.label and a.vec_id != b.vec_id where list_cosine_similarity(a.e, b.e) >= 0.93),
        r as (with recursive t(a, b) as (select vec_id, vec_id from v union select t.a, p.b from t join p on p.a = t.b) select a, min(b) as component_id from t group by a)
        select vec_id, coalesce(n, 0) as n_links, component_id, vec_id = component_id as kept
        from v left join (select a, count(*) as n from p group by a) p on vec_id = p.a join r on vec_id = r.a
    """,
    "op6_chat_windows": r"""
        with recursive c as (
            select conv_id, turn, role, text from conversations
            union all select -7, 0, 'user', '\### Assistant: </turn> ok' union all select -7, 1, 'assistant', '\### Assistant: </turn> ok'),
        a as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from c),
        e as (select *, '### ' || replace(replace(replace(replace(role, '\', '\\'), '#', '\#'), '</', '<\/'), ':', '\:') || ': '
                        || replace(replace(replace(text, '\', '\\'), '#', '\#'), '</', '<\/') || '</turn>' || chr(10) as block from a),
        b as (select *, row_number() over o - 1 as i, len(regexp_extract_all(block, '\w{1,4}|[^\w\s]')) as t, length(block) as ch from e
              window o as (partition by conv_id order by turn nulls first, role, text)),
        r as (select *, sum(t) over o as tt, sum(ch) over o as cc, count(*) over (partition by conv_id) as n,
                     first(role = 'system') over o as kept, first(t) over o as t0, first(ch) over o as c0 from b window o as (partition by conv_id order by i)),
        f as (select j.conv_id, j.i as s, case when j.i = 0 then 0 else min(h.i) end as fr
              from r j join r h on j.conv_id = h.conv_id and h.i <= j.i and h.i >= greatest(j.kept::int, j.i - 4)
               and (h.i = j.i or (j.tt - j.t - (h.tt - h.t) <= 128 and case when j.kept then j.t0 else 0 end + j.tt - (h.tt - h.t) <= 512)) or j.conv_id = h.conv_id and j.i = 0 and h.i = 0
              group by j.conv_id, j.i),
        g as (select f.conv_id, f.s, f.fr, any_value(h.tt - h.t) as tb, any_value(h.cc - h.ch) as cb, any_value(h.kept and f.s > 0) as lead, any_value(h.t0) as t0, any_value(h.c0) as c0, any_value(h.n) as n
              from f join r h on f.conv_id = h.conv_id and f.fr = h.i group by 1, 2, 3),
        x as (select g.conv_id, g.s, coalesce(min(j.i), any_value(g.n)) as e from g left join r j on j.conv_id = g.conv_id and j.i > g.s and j.tt - g.tb + case when g.lead then g.t0 else 0 end > 512 group by 1, 2),
        w as (select conv_id, 0 as s from x where s = 0 union all select w.conv_id, x.e from w join x on w.conv_id = x.conv_id and w.s = x.s join g on g.conv_id = x.conv_id and g.s = 0 where x.e < g.n),
        z as (select w.conv_id, sum(l.cc - g.cb + case when g.lead then g.c0 else 0 end) as formatted_chars, count(*) as n_windows
              from w join x on w.conv_id = x.conv_id and w.s = x.s join g on w.conv_id = g.conv_id and w.s = g.s join r l on l.conv_id = w.conv_id and l.i = x.e - 1 group by 1),
        y as (select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by i)) as turns_sha256,
                     coalesce(string_agg(text, '' order by i) filter (role = 'assistant'), '') as loss from r group by 1)
        select conv_id, n_turns, turns_sha256, length(loss) as loss_chars, sha256(loss) as loss_sha256, cast(formatted_chars as bigint) as formatted_chars, n_windows from y join z using (conv_id)
    """,
    "op10_ngram_join": """
        with d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') as w from documents),
        s as (select distinct doc_id, array_to_string(w[i:i + 4], ' ') as g from (select doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) as i from d where len(w) > 0)),
        n as (select doc_id, count(*) as n from s group by doc_id),
        c as (select a.doc_id as a, b.doc_id as b, count(*) as c from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by 1, 2),
        l as (select a, b from c join n x on a = x.doc_id join n y on b = y.doc_id where 100 * c >= 75 * (x.n + y.n - c)),
        p as (select a, b from l union all select b, a from l),
        r as (with recursive t(a, b) as (select doc_id, doc_id from d union select t.a, p.b from t join p on p.a = t.b) select a, min(b) as component_id from t group by a)
        select d.doc_id, coalesce(n, 0) as n_shingles, component_id from d left join n using (doc_id) join r on d.doc_id = r.a
    """,
    "op13_centroids": _op13_sql(),
}
