"""Scalar functions over the driver's texts, URLs and numbers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as X
from .flows import FLOWS_SQL, flows
from .registry import query

W = f"WITH {FLOWS_SQL} "


def _t(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


_HOST = r"regexp_extract(url, '^[a-z]+://([^/?#]+)', 1)"


@query(f"""
WITH h AS (SELECT page_id, {_HOST} AS host FROM pages),
c AS (SELECT page_id, host, unnest(list_distinct(string_split(host, ''))) AS ch FROM h),
p AS (SELECT page_id, (length(host) - length(replace(host, ch, ''))) / CAST(length(host) AS DOUBLE) AS p FROM c)
SELECT h.page_id, h.host, round(coalesce((SELECT -sum(p.p * log2(p.p)) FROM p WHERE p.page_id = h.page_id), 0.0), 3) AS entropy FROM h""")
def fn_entropy(spark, d):
    """Bits a character of host names."""
    return _t(spark, d, "pages").select("page_id", F.regexp_extract("url", r"^[a-z]+://([^/?#]+)", 1).alias("host")).select("page_id", "host", X.entropy("host").alias("entropy"))


@query(r"""
SELECT conv_id, turn, substr(trim(regexp_replace(regexp_replace(text, '[\r\n\t]', ' ', 'g'), '[^\x20-\x7E]', '.', 'g')), 1, 64) AS preview, length(text) > 64 AS cut,
    CASE WHEN length(text) = 0 THEN 'empty' WHEN starts_with(text, 'HTTP/1.') THEN 'http_response' WHEN regexp_matches(text, '^(GET|POST|HEAD|PUT|DELETE|OPTIONS|TRACE|CONNECT|PATCH) ') THEN 'http_request' WHEN regexp_matches(text, '[\x00-\x08\x0E-\x1F]') THEN 'binary' ELSE 'text' END AS kind
FROM conversations""")
def fn_preview(spark, d):
    """Printable preview, whether it was cut, and what the content seems to be."""
    return _t(spark, d, "conversations").select("conv_id", "turn", X.printable("text", 64).alias("preview"), X.preview_cut("text", 64).alias("cut"), X.content_type("text").alias("kind"))


_HEADERS = "'GET / HTTP/1.1' || chr(10) || 'Host: ' || {host} || chr(10) || 'Authorization: Bearer ' || page_id || chr(10) || 'COOKIE: a=' || page_id || chr(10) || 'X-Other: cookie: no'"


@query("SELECT page_id, regexp_replace(" + _HEADERS.format(host=_HOST) + r", '(?im)^(authorization|proxy-authorization|cookie|set-cookie|x-api-key|x-auth-token):[^\r\n]*', '\1: [redacted]', 'g') AS shown FROM pages")
def fn_redact(spark, d):
    """Values of secret headers are masked at line starts, before lines are joined."""
    text = F.concat(F.lit("GET / HTTP/1.1\nHost: "), F.regexp_extract("url", r"^[a-z]+://([^/?#]+)", 1), F.lit("\nAuthorization: Bearer "), F.col("page_id").cast("string"), F.lit("\nCOOKIE: a="), F.col("page_id").cast("string"), F.lit("\nX-Other: cookie: no"))
    return _t(spark, d, "pages").select("page_id", X.redact(text).alias("shown"))


@query(r"""SELECT event_id, k, list_has_any(parts, w) OR list_has_any(pairs, w) AS secret FROM (
    SELECT event_id, k, string_split_regex(lower(k), '[._/\-]+') AS parts, ['password', 'passwd', 'secret', 'token', 'apikey', 'authorization', 'cookie', 'credential', 'credentials'] AS w,
        list_transform(range(1, greatest(len(string_split_regex(lower(k), '[._/\-]+')), 1) + 1), lambda i: string_split_regex(lower(k), '[._/\-]+')[i] || coalesce(string_split_regex(lower(k), '[._/\-]+')[i + 1], '')) AS pairs
    FROM (SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'user.password' WHEN 1 THEN 'X-API-Key' WHEN 2 THEN 'tokens_used' WHEN 3 THEN 'Auth/Token' WHEN 4 THEN 'monkey' ELSE 'secretary' END || '_' || event_type AS k FROM events)
)""")
def fn_secret_keys(spark, d):
    """Key names judged segment by segment."""
    k = F.concat(F.element_at(F.array(*map(F.lit, ["user.password", "X-API-Key", "tokens_used", "Auth/Token", "monkey", "secretary"])), (F.col("event_id") % 6 + 1).cast("int")), F.lit("_"), F.col("event_type"))
    return _t(spark, d, "events").select("event_id", k.alias("k")).select("event_id", "k", X.is_secret_key("k").alias("secret"))


@query(rf"""SELECT event_id, array_to_string(regexp_extract_all('rule NET-' || upper(event_type) || '-001 in S-' || lpad(CAST(event_id % 1000000 AS VARCHAR), 6, '0') || ' from 10.0.0.' || event_id % 256 || ' value ' || value, '{X.TOKEN_PATTERN}'), ' ') AS tokens FROM (SELECT event_id, event_type, CAST(floor(value) AS BIGINT) AS value FROM events)""")
def fn_tokens(spark, d):
    """Ids, addresses and numbers that a text mentions."""
    text = F.concat(F.lit("rule NET-"), F.upper("event_type"), F.lit("-001 in S-"), F.lpad((F.col("event_id") % 1000000).cast("string"), 6, "0"), F.lit(" from 10.0.0."), (F.col("event_id") % 256).cast("string"), F.lit(" value "), F.floor("value").cast("string"))
    return _t(spark, d, "events").select("event_id", F.array_join(X.tokens(text), " ").alias("tokens"))


@query("SELECT event_id, array_to_string(list_filter(list_transform(string_split_regex(event_type || ' ，S-1; ' || event_id || '|/ x、y', '[，,、;；/|]'), lambda x: trim(x)), lambda x: length(x) > 0), '+') AS refs FROM events")
def fn_split_refs(spark, d):
    """Several references in one field, whatever separates them."""
    return _t(spark, d, "events").select("event_id", F.array_join(X.split_refs(F.concat("event_type", F.lit(" ，S-1; "), F.col("event_id").cast("string"), F.lit("|/ x、y"))), "+").alias("refs"))


@query(W + "SELECT seq, strftime(make_timestamp(ts_ns // 1000), '%Y-%m-%dT%H:%M:%SZ') AS at, printf('%.6f', (ts_ns % 1000000000) / 1e9) AS part, CASE WHEN length * 977 < 1024 THEN printf('%d B', length * 977) WHEN length * 977 < 1048576 THEN printf('%.1f KiB', length * 977 / 1024.0) ELSE printf('%.1f MiB', length * 977 / 1048576.0) END AS human FROM flows")
def fn_times_and_sizes(spark, d):
    """RFC 3339 seconds, six decimals, and sizes in binary units."""
    n = F.col("length") * 977
    return flows(spark, d).select("seq", X.rfc3339("ts_ns").alias("at"), X.human_seconds((F.col("ts_ns") % 1_000_000_000) / 1e9).alias("part"), X.human_bytes(n).alias("human"))


@query("SELECT event_id, CASE WHEN regexp_matches(t, '^[0-9]+\\s*[kmg]?i?b?$') AND t <> 'i' THEN CAST(regexp_extract(t, '^([0-9]+)', 1) AS BIGINT) * CASE regexp_extract(t, '^[0-9]+\\s*([kmg]?)', 1) WHEN 'k' THEN 1024 WHEN 'm' THEN 1048576 WHEN 'g' THEN 1073741824 ELSE 1 END END AS bytes FROM (SELECT event_id, lower(trim(event_id || CASE event_id % 5 WHEN 0 THEN ' KiB' WHEN 1 THEN 'm' WHEN 2 THEN '' WHEN 3 THEN ' GB' ELSE ' parsecs' END)) AS t FROM events)")
def fn_parse_byte_size(spark, d):
    """Sizes with units; null for what isn't one."""
    unit = F.element_at(F.array(*map(F.lit, [" KiB", "m", "", " GB", " parsecs"])), (F.col("event_id") % 5 + 1).cast("int"))
    return _t(spark, d, "events").select("event_id", X.parse_byte_size(F.concat(F.col("event_id").cast("string"), unit)).alias("bytes"))


@query(W + "SELECT seq, array_to_string(list_filter([CASE WHEN (flags & 1) <> 0 THEN 'FIN' END, CASE WHEN (flags & 2) <> 0 THEN 'SYN' END, CASE WHEN (flags & 4) <> 0 THEN 'RST' END, CASE WHEN (flags & 8) <> 0 THEN 'PSH' END, CASE WHEN (flags & 16) <> 0 THEN 'ACK' END], lambda x: x IS NOT NULL), ',') AS names, flags AS mask FROM flows")
def fn_flag_names(spark, d):
    """A mask as names, and the names as a mask again."""
    own = flows(spark, d).select("seq", X.mask_to_flags("flags").alias("n"))
    return own.select("seq", F.array_join("n", ",").alias("names"), X.flags_to_mask("n").alias("mask"))


@query(W + "SELECT seq, src || ':' || src_port || '-' || dst || ':' || dst_port AS packet_key, 'src_ip=' || src || '|protocol=' || proto || '|dst_port=' || dst_port AS grp FROM flows WHERE src IS NOT NULL")
def fn_keys(spark, d):
    """The directional packet key and a rendered group."""
    c = F.col
    return flows(spark, d).where("src IS NOT NULL").select("seq", X.packet_key(c("src"), c("src_port"), c("dst"), c("dst_port")).alias("packet_key"), X.group_key(src_ip=c("src"), protocol=c("proto"), dst_port=c("dst_port")).alias("grp"))


@query(W + "SELECT DISTINCT src, '4:' || array_to_string(list_transform(string_split(src, '.'), lambda x: lpad(x, 3, '0')), '.') AS key FROM flows WHERE src IS NOT NULL")
def fn_ip_key(spark, d):
    """Addresses as text that sorts as numbers do."""
    return flows(spark, d).where("src IS NOT NULL").select("src").distinct().select("src", X.ip_key("src").alias("key"))


@query("SELECT event_id, CASE WHEN d >= 2147483648 THEN d - 4294967296 ELSE d END AS distance FROM (SELECT event_id, (((event_id * 2654435761) % 4294967296) - ((event_id * 40503) % 4294967296)) & 4294967295 AS d FROM events)")
def fn_seq_distance(spark, d):
    """Signed distance of 32-bit sequence numbers."""
    a, b = F.col("event_id") * 40503 % 4294967296, F.col("event_id") * 2654435761 % 4294967296
    return _t(spark, d, "events").select("event_id", X.seq_distance(a, b).alias("distance"))


@query("SELECT event_id, CASE WHEN event_id % 9 = 0 THEN NULL ELSE CAST(json_extract(props, '$.k') AS BIGINT) END AS k, substr(sha256(props), 1, 8) AS hash FROM events")
def fn_json_and_hash(spark, d):
    """JSON or null, and the eight-digit content hash."""
    own = _t(spark, d, "events").withColumn("bad", F.when(F.col("event_id") % 9 == 0, F.lit("{broken")).otherwise(F.col("props")))
    return own.select("event_id", X.parse_json_or_null("bad", "k BIGINT")["k"].alias("k"), X.content_hash("props").alias("hash"))


@query("SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'half_closed' WHEN 1 THEN 'buffer_overflow' WHEN 2 THEN 'active' ELSE 'syn_first' END AS state FROM orders")
def fn_state_words(spark, d):
    """Stored spellings without underscores are read with them."""
    given = F.element_at(F.array(*map(F.lit, ["HalfClosed", "bufferoverflow", "Active", "synfirst"])), (F.col("o_orderkey") % 4 + 1).cast("int"))
    return _t(spark, d, "orders").select("o_orderkey", X.state_word(given).alias("state"))


@query("SELECT event_id, array_to_string(list_sort(list_distinct([a[1], a[CAST(floor((n - 1) / 4.0) AS INT) + 1], a[CAST(floor((n - 1) / 2.0) AS INT) + 1], a[CAST(floor((n - 1) * 3 / 4.0) AS INT) + 1], a[n]])), ',') AS picked FROM (SELECT event_id, range(0, event_id % 23 + 1) AS a, CAST(event_id % 23 + 1 AS INT) AS n FROM events)")
def fn_even_sample(spark, d):
    """Up to five values at even distances."""
    return _t(spark, d, "events").select("event_id", F.array_join(F.transform(X.even_sample(F.sequence(F.lit(0), F.col("event_id") % 23)), lambda x: x.cast("string")), ",").alias("picked"))


_SAID = "CASE WHEN seq % 11 = 0 THEN 'SCTP' WHEN seq % 13 = 0 THEN NULL WHEN seq % 3 = 0 THEN upper(proto) ELSE proto END"


@query(W + f"SELECT seq, CASE WHEN said IS NULL THEN NULL WHEN lower(said) IN ('tcp', 'udp', 'icmp', 'icmpv6', 'arp', 'ipv4', 'ipv6', 'other') THEN lower(said) ELSE 'other' END AS name FROM (SELECT seq, {_SAID} AS said FROM flows)")
def fn_protocol_name(spark, d):
    """Names in any case, those that aren't known, and none."""
    return flows(spark, d).select("seq", F.expr(_SAID).alias("said")).select("seq", X.protocol_name("said").alias("name"))


@query(W + "SELECT seq, 2 AS n, seq AS first_start, seq + length AS first_end, seq + 2000 AS last_start, seq + 2000 + length AS last_end FROM flows")
def fn_ranges_to_pairs(spark, d):
    """X22."""
    span = lambda at: F.struct(at.alias("start"), (at + F.col("length")).alias("end"))
    pairs = flows(spark, d).select("seq", X.ranges_to_pairs(F.array(span(F.col("seq")), span(F.col("seq") + 2000))).alias("p"))
    return pairs.select("seq", F.size("p").alias("n"), F.col("p")[0][0].alias("first_start"), F.col("p")[0][1].alias("first_end"), F.col("p")[1][0].alias("last_start"), F.col("p")[1][1].alias("last_end"))


@query(W + "SELECT proto, count(*) AS packets FROM flows WHERE proto IN ('tcp', 'udp', 'icmp', 'icmpv6') GROUP BY proto")
def summary_protocols(spark, d):
    """The summary's transport counts as a map, one row an entry."""
    from ..operators.sessions import capture_summary, protocols_map

    return protocols_map(capture_summary(flows(spark, d))).select(F.explode("protocols").alias("proto", "packets"))
