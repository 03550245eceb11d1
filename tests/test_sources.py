import io
import random

import pytest

from tidewire.sources import synth
from tidewire.sources.capture import read_captures, register
from tidewire.sources.capture_format import Notes, UnsupportedCapture, detect_format, read_capture
from tidewire.sources.decode import decode, decode_packet, entropy_bits, parse_dhcp, parse_dns, parse_http, parse_tls, status_of

T0 = 1_700_000_000_123_456_789


def records(data, notes=None):
    return list(read_capture(io.BytesIO(data), notes))


@pytest.mark.parametrize("nano", [False, True])
@pytest.mark.parametrize("big", [False, True])
def test_classic(nano, big):
    got = records(synth.classic_file([(T0, b"abc"), (T0 + 1000, b"d" * 9)], nano, big, snap=5))
    assert [(r.captured_len, r.original_len, r.raw) for r in got] == [(3, 3, b"abc"), (5, 9, b"ddddd")]
    assert got[0].ts_ns == (T0 if nano else T0 // 1000 * 1000) and got[0].precision == ("ns" if nano else "us")


@pytest.mark.parametrize("resolution,precision", [(9, "ns"), (6, "us"), (3, "ms"), (0x80 | 20, "us"), (0, "s")])
def test_blocks(resolution, precision):
    got = records(synth.block_file([(T0, b"abc"), (T0, b"defgh")], resolution, interfaces=2))
    assert [r.interface_id for r in got] == [0, 1] and got[1].raw == b"defgh" and got[0].precision == precision
    assert abs(got[0].ts_ns - T0) < {"ns": 1, "us": 2000, "ms": 2_000_000, "s": 2_000_000_000}[precision]


def test_blocks_that_are_passed_over():
    notes = Notes()
    got = records(synth.block_file([(T0, b"abc")], extra=[(5, b"\0" * 8), (0x0BAD, b"abcd"), (6, b"\x07\0\0\0" + b"\0" * 16), (3, b"\3\0\0\0xyz\0")]), notes)
    assert [r.raw for r in got] == [b"xyz", b"abc"]
    assert notes.counts == {"statistics": 1, "unknown_block": 1, "unknown_interface": 1} and len(notes.nonfatal) == 2


def test_cut_files_never_crash():
    whole = synth.block_file(list(synth.traffic("mixed", 5)))
    classic = synth.classic_file(list(synth.traffic("mixed", 5)))
    for data in (whole, classic):
        n = len(records(data))
        for cut in range(0, len(data), 7):
            try:
                assert len(records(data[:cut])) <= n
            except UnsupportedCapture:
                assert cut < 24
    r = random.Random(5)
    for n in (0, 1, 15, 16, 23, 24, 25, 100, 4096):
        junk = bytes(r.randrange(256) for _ in range(n))
        with pytest.raises(UnsupportedCapture):
            records(junk)
    for head in (synth.classic_file([])[:24], synth.block_file([])):
        for _ in range(50):
            records(head + bytes(r.randrange(256) for _ in range(r.randrange(200))))
    with pytest.raises(UnsupportedCapture):
        detect_format(b"x" * 16)


def test_decoder_never_raises():
    r = random.Random(9)
    for _, frame in [x for p in synth.PROFILES for x in synth.traffic(p, 20, 3)]:
        for _ in range(10):
            broken = bytearray(frame[: r.randrange(len(frame) + 1)])
            for _ in range(r.randrange(4)):
                if broken:
                    broken[r.randrange(len(broken))] = r.randrange(256)
            for kind in (1, 113, 7):
                out = decode_packet(kind, bytes(broken))
                assert status_of(out) in ("ok", "partial", "error")


def test_layers():
    eth = lambda ip, t=0x0800, **k: decode_packet(1, synth.ethernet(ip, t, **k))
    tcp = eth(synth.ipv4(synth.tcp(40000, 80, 7, 9, 18, b"GET / HTTP/1.1\r\nHost: A.B\r\nUser-Agent: x\r\n\r\n"), "10.0.0.1", "10.0.0.2", 6), vlans=[5, 6])
    assert tcp["link"]["vlan_ids"] == [5, 6] and tcp["transport"]["flags"] == ["SYN", "ACK"] and tcp["transport"]["seq"] == 7
    assert tcp["application"]["protocol"] == "http" and tcp["application"]["http"]["host"] == "a.b"
    six = eth(synth.ipv6(synth.udp(1, 2, b"zz"), "2001:db8::1", "::1", 17), 0x86DD)
    assert six["network"]["src"] == "2001:db8::1" and six["network"]["ip_version"] == 6 and six["payload"] == (14 + 40 + 8, 2)
    arp = eth(synth.arp("1.2.3.4", "5.6.7.8"), 0x0806)
    assert arp["network"]["protocol"] == "arp" and arp["transport"] is None and not arp["errors"]
    frag = eth(synth.ipv4(synth.udp(1, 53, synth.dns_query("a.b")), "1.1.1.1", "2.2.2.2", 17, more=True))
    assert frag["network"]["is_fragment"] and frag["application"] is None
    sll = decode_packet(113, synth.linux_sll(synth.ipv4(synth.icmp(8, 0, b"p"), "1.1.1.1", "2.2.2.2", 1)))
    assert sll["link"]["sll_protocol"] == 0x0800 and sll["transport"]["icmp"] == {"icmp_type": 8, "code": 0}
    assert decode_packet(99, b"")["errors"][0]["code"] == "unsupported_linktype"
    cut = decode_packet(1, synth.ethernet(synth.ipv4(synth.tcp(1, 2), "1.1.1.1", "2.2.2.2", 6)[:30]))
    assert (cut["errors"][0]["layer"], cut["errors"][0]["code"]) == ("ipv4", "truncated_header")
    wrong = bytearray(synth.ipv4(synth.tcp(1, 2), "1.1.1.1", "2.2.2.2", 6))
    wrong[0] = 0x65
    assert decode_packet(1, synth.ethernet(bytes(wrong)))["errors"][0]["code"] == "invalid_field"


def test_applications():
    d = parse_dns(synth.dns_query("WWW.Example.com", 9, 16, [b"a" * 30, b"b" * 40]))
    assert (d["qname"], d["txt_len"], d["is_response"], d["answer_count"], d["max_label_len"]) == ("www.example.com", 70, True, 2, 7)
    assert parse_dns(b"\0" * 11) is None
    loop = b"\0\1\1\0\0\1\0\0\0\0\0\0" + b"\xc0\x0c" + b"\0\1\0\1"
    assert parse_dns(loop) is None
    assert parse_tls(synth.client_hello("Host.Example"))["sni"] == "host.example"
    assert parse_tls(b"\x17\x03\x03\0\5abcde") == {"record_type": 23, "version": 771, "is_client_hello": False, "sni": None}
    assert parse_http(b"HTTP/1.1 404 Not Found\r\nContent-Length: 12\r\n\r\n")["status_code"] == 404
    assert parse_http(b"BREW / HTTP/1.1\r\n") is None
    got = parse_dhcp(synth.dhcp(3, "10.1.2.3", b"\x01\x02"))
    assert (got["dhcp_type"], got["requested_ip"], got["client_id"]) == (3, "10.1.2.3", "0102")
    assert entropy_bits(b"") == 0 and entropy_bits(b"aaaa") == 0 and entropy_bits(b"abcd") == 2.0


def test_files_as_tables(spark, tmp_path):
    register(spark)
    a, b = tmp_path / "a.pcap", tmp_path / "b.pcapng"
    a.write_bytes(synth.classic_file(list(synth.traffic("http", 10))))
    b.write_bytes(synth.block_file(list(synth.traffic("dns", 7))))
    got = spark.read.format("capture").option("path", f"{a},{b}").load()
    assert got.count() == 17
    by_path = read_captures(spark, str(tmp_path))
    assert by_path.select("path", "sha256").distinct().count() == 2
    packets = decode(by_path)
    assert {r.p: r.n for r in packets.groupBy(packets["application.protocol"].alias("p")).count().withColumnRenamed("count", "n").collect()} == {"http": 10, "dns": 7}
    assert packets.where("decode_status <> 'ok'").count() == 0
