"""Scalar functions of the engine as Spark expressions. All stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bit of each TCP flag.
FLAG_BITS = {"FIN": 1, "SYN": 2, "RST": 4, "PSH": 8, "ACK": 16, "URG": 32, "ECE": 64, "CWR": 128}
#: Headers whose values are secret.
SECRET_HEADERS = ("authorization", "proxy-authorization", "cookie", "set-cookie", "x-api-key", "x-auth-token")
#: Words that make a key secret.
SECRET_WORDS = ("password", "passwd", "secret", "token", "apikey", "authorization", "cookie", "credential", "credentials")
PROTOCOL_NAMES = ("tcp", "udp", "icmp", "icmpv6", "arp", "ipv4", "ipv6", "other")


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def floor_div(a: Column | str, b: int | Column) -> Column:
    """Whole division towards minus infinity, in whole numbers: doubles can't hold nanoseconds since 1970."""
    a, b = _c(a).cast("long"), (F.lit(b) if isinstance(b, int) else b).cast("long")
    return F.call_function("div", a - F.pmod(a, b), b)


def ip_key(ip: Column | str) -> Column:
    """A string that sorts as addresses do: all IPv4 before all IPv6, bytes in order. Null for null.

    IPv6 text is taken in its canonical form; the gap of ``::`` is filled with zero groups.
    """
    ip = _c(ip)
    four = F.concat(F.lit("4:"), F.array_join(F.transform(F.split(ip, "\\."), lambda x: F.lpad(x, 3, "0")), "."))
    halves = F.split(ip, "::", 2)
    groups = lambda s: F.when(F.length(s) > 0, F.split(s, ":")).otherwise(F.array().cast("array<string>"))
    head, tail = groups(halves[0]), groups(F.coalesce(F.get(halves, F.lit(1)), F.lit("")))
    full = F.concat(head, F.array_repeat(F.lit("0"), F.greatest(F.lit(0), 8 - F.size(head) - F.size(tail))), tail)
    six = F.concat(F.lit("6:"), F.array_join(F.transform(full, lambda x: F.lpad(x, 4, "0")), ":"))
    return F.when(ip.contains(":"), six).otherwise(four)


def same_ip(a: Column | str, b: Column | str) -> Column:
    """Equality of addresses, not of their spelling."""
    return ip_key(a) == ip_key(b)


def flags_to_mask(names: Column | str) -> Column:
    """The bit mask of an array of flag names; unknown names are ignored."""
    names = _c(names)
    return sum((F.when(F.array_contains(names, n), F.lit(b)).otherwise(F.lit(0)) for n, b in FLAG_BITS.items()), F.lit(0))


def mask_to_flags(mask: Column | str) -> Column:
    """Names of the set bits, low bits first."""
    mask = _c(mask)
    return F.array_compact(F.array(*[F.when(mask.bitwiseAND(F.lit(b)) != 0, F.lit(n)) for n, b in FLAG_BITS.items()]))


def has_flags(mask: Column | str, *names: str) -> Column:
    """All of ``names`` are set; names that don't exist are ignored."""
    want = sum(FLAG_BITS.get(n.upper(), 0) for n in names)
    return _c(mask).bitwiseAND(F.lit(want)) == want


def bare_syn(mask: Column | str) -> Column:
    return _c(mask).bitwiseAND(F.lit(18)) == 2


def syn_ack(mask: Column | str) -> Column:
    return _c(mask).bitwiseAND(F.lit(18)) == 18


def ticks_to_ns(seconds: Column, fraction: Column, ticks: Column) -> Column:
    whole = lambda c: c.cast("long")
    return whole(seconds) * 1_000_000_000 + floor_div(whole(fraction) * 1_000_000_000, ticks)


def precision_class(ticks: Column | str) -> Column:
    t = _c(ticks)
    return F.when(t >= 1_000_000_000, "ns").when(t >= 1_000_000, "us").when(t >= 1000, "ms").otherwise("s")


def entropy(text: Column | str) -> Column:
    """Shannon entropy in bits a character, to three decimals; 0 for an empty text."""
    text = _c(text)
    n = F.length(text)
    letters = F.array_sort(F.array_distinct(F.split(text, "")))
    share = lambda ch: (n - F.length(F.replace(text, ch, F.lit("")))) / n
    total = F.aggregate(F.filter(letters, lambda ch: ch != ""), F.lit(0.0), lambda acc, ch: acc - share(ch) * F.log2(share(ch)))
    return F.when(n > 0, F.round(total, 3)).otherwise(F.when(text.isNotNull(), F.lit(0.0)))


def protocol_name(proto: Column | str) -> Column:
    return F.when(F.lower(_c(proto)).isin(*PROTOCOL_NAMES), F.lower(_c(proto))).otherwise(F.when(_c(proto).isNotNull(), F.lit("other")))


def endpoint(ip: Column | str, port: Column | str) -> Column:
    return F.concat_ws(":", _c(ip), _c(port).cast("string"))


def session_key(proto: Column, a: Column, a_port: Column, b: Column, b_port: Column) -> Column:
    return F.concat_ws("|", proto, endpoint(a, a_port), endpoint(b, b_port))


def packet_key(src: Column, sport: Column, dst: Column, dport: Column) -> Column:
    """Directional, unlike the session's key."""
    return F.concat(endpoint(src, sport), F.lit("-"), endpoint(dst, dport))


def group_key(**parts: Column) -> Column:
    """k=v pairs with bars between; what is missing is empty."""
    return F.concat_ws("|", *[F.concat(F.lit(f"{k}="), F.coalesce(v.cast("string"), F.lit(""))) for k, v in parts.items()])


def mac_text(mac: Column | str) -> Column:
    """Six bytes as aa:bb:cc:dd:ee:ff."""
    return F.rtrim(F.regexp_replace(F.lower(F.hex(_c(mac))), "(..)", "$1:"), F.lit(":"))


def printable(data: Column | str, limit: int = 256) -> Column:
    """A preview: line ends and tabs become spaces, what can't be shown becomes a dot, ends are trimmed."""
    text = F.regexp_replace(_c(data).cast("string"), r"[\r\n\t]", " ")
    return F.substring(F.trim(F.regexp_replace(text, r"[^\x20-\x7E]", ".")), 1, limit)


def preview_cut(data: Column | str, limit: int = 256) -> Column:
    return F.length(_c(data)) > limit


def content_type(text: Column | str) -> Column:
    """What a payload seems to be: http_response, http_request, text, binary or empty."""
    t = _c(text)
    return (
        F.when(F.length(t) == 0, "empty")
        .when(t.startswith("HTTP/1."), "http_response")
        .when(t.rlike(r"^(GET|POST|HEAD|PUT|DELETE|OPTIONS|TRACE|CONNECT|PATCH) "), "http_request")
        .when(t.rlike(r"^[\x14-\x17]\x03"), "tls")
        .when(t.rlike(r"[\x00-\x08\x0E-\x1F]"), "binary")
        .otherwise("text")
    )


def redact(text: Column | str) -> Column:
    """Values of secret headers at line starts are masked. Do this before lines are joined for a preview."""
    return F.regexp_replace(_c(text), "(?im)^(" + "|".join(SECRET_HEADERS) + r"):[^\r\n]*", "$1: [redacted]")


def is_secret_key(key: Column | str) -> Column:
    """A segment of the key (parts between . _ - /) or two neighbours joined are a secret word."""
    parts = F.split(F.lower(_c(key)), r"[._/\-]+")
    pairs = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts), F.lit(1))), lambda i: F.concat(F.get(parts, i - 1), F.coalesce(F.get(parts, i), F.lit(""))))
    words = F.array(*map(F.lit, SECRET_WORDS))
    return F.arrays_overlap(parts, words) | F.arrays_overlap(pairs, words)


#: What in a report counts as a token of the engine.
TOKEN_PATTERN = r"\b[A-Z][A-Z0-9]*(?:-[A-Z0-9]+)*-[0-9]{3}\b|\bS-[0-9]{6}\b|\b(?:alert|tc|task)_[0-9A-Z]{26}\b|\b(?:[0-9]{1,3}\.){3}[0-9]{1,3}\b|\b[0-9]+(?:\.[0-9]+)?\b"


def tokens(text: Column | str) -> Column:
    """Rule ids, session ids, call ids, addresses and numbers of a text, in order."""
    return F.regexp_extract_all(_c(text), F.lit(TOKEN_PATTERN), F.lit(0))


def split_refs(text: Column | str) -> Column:
    """Several references in one field, split at commas, semicolons, bars and slashes of both widths."""
    return F.filter(F.transform(F.split(_c(text), "[，,、;；/|]"), lambda x: F.trim(x)), lambda x: F.length(x) > 0)


def rfc3339(ns: Column | str) -> Column:
    """Nanoseconds as RFC 3339 text in seconds; the session's time zone is UTC."""
    return F.date_format(F.timestamp_seconds(floor_div(ns, 1_000_000_000)), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def human_seconds(seconds: Column | str) -> Column:
    return F.format_string("%.6f", _c(seconds))


def duration_seconds(first_ns: Column | str, last_ns: Column | str) -> Column:
    return (_c(last_ns) - _c(first_ns)) / 1e9


def human_bytes(n: Column | str) -> Column:
    n = _c(n)
    shown = lambda unit, scale: F.format_string(f"%.1f {unit}", F.bround(n / scale, 1))
    return F.when(n < 1024, F.format_string("%d B", n)).when(n < 1024**2, shown("KiB", 1024)).when(n < 1024**3, shown("MiB", 1024**2)).otherwise(shown("GiB", 1024**3))


def parse_byte_size(text: Column | str) -> Column:
    """Text such as 64k, 8 MiB or 100 as bytes; null if it isn't one."""
    t = F.lower(F.trim(_c(text)))
    number, unit = F.regexp_extract(t, r"^([0-9]+)\s*([kmg]?)(?:i?b)?$", 1), F.regexp_extract(t, r"^([0-9]+)\s*([kmg]?)(?:i?b)?$", 2)
    scale = F.when(unit == "k", 1024).when(unit == "m", 1024**2).when(unit == "g", 1024**3).otherwise(1)
    return F.when(number != "", number.cast("long") * scale)


def even_sample(values: Column | str, n: int = 5) -> Column:
    """Up to ``n`` values at even distances, first and last among them, sorted and distinct."""
    v = _c(values)
    at = [F.floor((F.size(v) - 1) * k / (n - 1)).cast("int") for k in range(n)]
    return F.array_sort(F.array_distinct(F.array_compact(F.array(*[F.get(v, a) for a in at]))))


def ranges_to_pairs(ranges: Column | str) -> Column:
    return F.transform(_c(ranges), lambda r: F.array(r["start"], r["end"]))


def be_uint(data: Column | str, at: int, n: int) -> Column:
    """An unsigned big-endian number of ``n`` bytes at an offset of a binary column."""
    return F.conv(F.hex(F.substring(_c(data), at + 1, n)), 16, 10).cast("long")


def seq_distance(a: Column | str, b: Column | str) -> Column:
    """Signed distance from a to b in the space of 32-bit sequence numbers."""
    d = (_c(b) - _c(a)).bitwiseAND(F.lit(0xFFFFFFFF))
    return F.when(d >= 1 << 31, d - (1 << 32)).otherwise(d)


def parse_json_or_null(text: Column | str, schema: str) -> Column:
    return F.from_json(_c(text), schema)


def content_hash(text: Column | str) -> Column:
    """The first eight hex digits of SHA-256."""
    return F.substring(F.sha2(_c(text), 256), 1, 8)


def state_word(text: Column | str) -> Column:
    """Spellings of states and bases without underscores get them back."""
    t = F.lower(_c(text))
    known = F.create_map(*[F.lit(x) for p in {"halfclosed": "half_closed", "bufferoverflow": "buffer_overflow", "synfirst": "syn_first", "firstseen": "first_seen"}.items() for x in p])
    return F.coalesce(F.get(F.array(known[t]), F.lit(0)), t)
