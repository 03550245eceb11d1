"""Making packets and captures: frames of all supported layers, both file formats, and traffic profiles for trials."""

from __future__ import annotations

import ipaddress
import random
import struct
from collections.abc import Iterable, Iterator

FLAG = {"FIN": 1, "SYN": 2, "RST": 4, "PSH": 8, "ACK": 16, "URG": 32, "ECE": 64, "CWR": 128}


def ethernet(payload: bytes, ethertype: int = 0x0800, vlans: Iterable[int] = (), src: str = "02:00:00:00:00:01", dst: str = "02:00:00:00:00:02") -> bytes:
    mac = lambda m: bytes.fromhex(m.replace(":", ""))
    tags, vlans = b"", list(vlans)
    kind = ethertype
    for k, v in enumerate(reversed(vlans)):
        tags = struct.pack(">HH", v, kind) + tags
        kind = 0x88A8 if k + 1 < len(vlans) and k + 2 == len(vlans) else 0x8100
    return mac(dst) + mac(src) + struct.pack(">H", kind) + tags + payload


def linux_sll(payload: bytes, protocol: int = 0x0800, address: bytes = b"\x02\x00\x00\x00\x00\x03") -> bytes:
    return struct.pack(">HHH", 0, 1, 6) + address + b"\0\0" + struct.pack(">H", protocol) + payload


def ipv4(payload: bytes, src: str, dst: str, proto: int, ttl: int = 64, fragment: int = 0, more: bool = False) -> bytes:
    head = struct.pack(">BBHHHBBH", 0x45, 0, 20 + len(payload), 1, (0x2000 if more else 0) | fragment, ttl, proto, 0)
    return head + ipaddress.IPv4Address(src).packed + ipaddress.IPv4Address(dst).packed + payload


def ipv6(payload: bytes, src: str, dst: str, proto: int, hops: int = 64) -> bytes:
    return struct.pack(">IHBB", 6 << 28, len(payload), proto, hops) + ipaddress.IPv6Address(src).packed + ipaddress.IPv6Address(dst).packed + payload


def tcp(sport: int, dport: int, seq: int = 0, ack: int = 0, flags: int = 16, data: bytes = b"", window: int = 65535) -> bytes:
    return struct.pack(">HHIIBBHHH", sport, dport, seq & 0xFFFFFFFF, ack & 0xFFFFFFFF, 5 << 4, flags, window, 0, 0) + data


def udp(sport: int, dport: int, data: bytes = b"") -> bytes:
    return struct.pack(">HHHH", sport, dport, 8 + len(data), 0) + data


def icmp(kind: int = 8, code: int = 0, data: bytes = b"") -> bytes:
    return struct.pack(">BBHI", kind, code, 0, 0) + data


def arp(src: str, dst: str) -> bytes:
    return struct.pack(">HHBBH", 1, 0x0800, 6, 4, 1) + b"\2" * 6 + ipaddress.IPv4Address(src).packed + b"\0" * 6 + ipaddress.IPv4Address(dst).packed


def dns_query(name: str, ident: int = 1, qtype: int = 1, texts: Iterable[bytes] = (), response: bool = False) -> bytes:
    texts = list(texts)
    q = b"".join(bytes([len(p)]) + p.encode() for p in name.split(".")) + b"\0"
    out = struct.pack(">HHHHHH", ident, 0x8180 if response or texts else 0x0100, 1, len(texts), 0, 0) + q + struct.pack(">HH", qtype, 1)
    for t in texts:
        body = bytes([len(t)]) + t
        out += b"\xc0\x0c" + struct.pack(">HHIH", 16, 1, 60, len(body)) + body
    return out


def client_hello(host: str) -> bytes:
    name = host.encode()
    sni = struct.pack(">HBH", len(name) + 3, 0, len(name)) + name
    extensions = struct.pack(">HH", 0, len(sni)) + sni
    body = b"\x03\x03" + bytes(32) + b"\0" + struct.pack(">H", 2) + b"\x13\x01" + b"\x01\0" + struct.pack(">H", len(extensions)) + extensions
    hello = b"\x01" + len(body).to_bytes(3, "big") + body
    return b"\x16\x03\x01" + struct.pack(">H", len(hello)) + hello


def dhcp(kind: int = 1, requested: str | None = None, client: bytes = b"") -> bytes:
    out = b"\x01\x01\x06\0" + bytes(232) + b"\x63\x82\x53\x63" + bytes([53, 1, kind])
    if requested:
        out += bytes([50, 4]) + ipaddress.IPv4Address(requested).packed
    if client:
        out += bytes([61, len(client)]) + client
    return out + b"\xff"


def classic_file(frames: Iterable[tuple[int, bytes]], nano: bool = False, big: bool = False, linktype: int = 1, snap: int = 65535) -> bytes:
    """A classic capture of (ts_ns, frame)."""
    o = ">" if big else "<"
    out = [struct.pack(o + "IHHiIII", 0xA1B23C4D if nano else 0xA1B2C3D4, 2, 4, 0, 0, snap, linktype)]
    for ts, frame in frames:
        kept = frame[:snap]
        out.append(struct.pack(o + "IIII", ts // 10**9, ts % 10**9 // (1 if nano else 1000), len(kept), len(frame)) + kept)
    return b"".join(out)


def _block(kind: int, body: bytes) -> bytes:
    body += b"\0" * (-len(body) % 4)
    n = 12 + len(body)
    return struct.pack("<II", kind, n) + body + struct.pack("<I", n)


def block_file(frames: Iterable[tuple[int, bytes]], tsresol: int = 9, interfaces: int = 1, linktype: int = 1, extra: Iterable[tuple[int, bytes]] = ()) -> bytes:
    """A block capture of (ts_ns, frame), dealt over the interfaces in turn; ``extra`` blocks follow the interfaces."""
    out = [_block(0x0A0D0D0A, struct.pack("<IHHq", 0x1A2B3C4D, 1, 0, -1))]
    out += [_block(1, struct.pack("<HHI", linktype, 0, 65535) + struct.pack("<HHB3xHH", 9, 1, tsresol, 0, 0))] * interfaces
    out += [_block(k, b) for k, b in extra]
    ticks = 2 ** (tsresol & 0x7F) if tsresol & 0x80 else 10**tsresol
    for k, (ts, frame) in enumerate(frames):
        t = ts // 10**9 * ticks + ts % 10**9 * ticks // 10**9
        out.append(_block(6, struct.pack("<IIIII", k % interfaces, t >> 32, t & 0xFFFFFFFF, len(frame), len(frame)) + frame))
    return b"".join(out)


PROFILES = ("mixed", "http", "dns", "dns-tunnel", "syn-flood", "port-sweep", "malformed")


def traffic(profile: str = "mixed", n: int = 100, seed: int = 1, start_ns: int = 1_700_000_000_000_000_000, gap_ns: int = 100_000, vlans: Iterable[int] = ()) -> Iterator[tuple[int, bytes]]:
    """(ts_ns, frame) of ``n`` packets of a kind of traffic, the same for the same seed."""
    if profile not in PROFILES:
        raise ValueError(f"profile {profile!r} isn't one of {', '.join(PROFILES)}")
    r = random.Random(seed)
    letters = "abcdefghijklmnopqrstuvwxyz0123456789"
    for k in range(n):
        ts = start_ns + k * gap_ns
        kind = r.choice(("http", "dns", "tls")) if profile == "mixed" else profile
        client, server = f"10.0.0.{k % 20 + 1}", f"192.168.1.{k % 5 + 1}"
        port = 40000 + k % 1000
        if kind == "http":
            up = k % 2 == 0
            data = b"GET /%d HTTP/1.1\r\nHost: Www.Example.com\r\n\r\n" % k if up else b"HTTP/1.1 200 OK\r\nContent-Length: 0\r\n\r\n"
            seg = tcp(port, 80, 1000 + k, 1, 24, data) if up else tcp(80, port, 5000 + k, 1, 24, data)
            ip = ipv4(seg, client if up else server, server if up else client, 6)
        elif kind == "tls":
            ip = ipv4(tcp(port, 443, 1, 1, 24, client_hello(f"host{k % 50}.example.com")), client, server, 6)
        elif kind == "dns":
            ip = ipv4(udp(port, 53, dns_query(f"www{k % 9}.example.com", k & 0xFFFF)), client, "192.168.1.53", 17)
        elif kind == "dns-tunnel":
            name = "".join(r.choice(letters) for _ in range(40))
            ip = ipv4(udp(port, 53, dns_query(f"{name}.t.example.com", k & 0xFFFF)), "10.0.0.9", "192.168.1.53", 17)
        elif kind == "syn-flood":
            ip = ipv4(tcp(1024 + k % 60000, 80, k, 0, 2), "10.0.0.66", "192.168.1.80", 6)
        elif kind == "port-sweep":
            ip = ipv4(tcp(50000, 1 + k % 65000, k, 0, 2), "10.0.0.77", "192.168.1.80", 6)
        else:
            whole = ipv4(tcp(port, 80, k), client, server, 6)
            ip = whole[: r.randint(1, 19)] if k % 2 else whole[:20] + whole[20 : 20 + r.randint(0, 12)]
        yield ts, ethernet(ip, vlans=vlans)
