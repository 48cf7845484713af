"""DuckDB SQL that gives the expected result of each query straight from the tables: no dump, no
parsing, no captured responses."""

from __future__ import annotations


def _v6(prefix: str, n: str) -> str:
    return (f"'{prefix}::' || CASE WHEN {n} >= 65536 THEN format('{{:x}}', {n} // 65536) || ':' "
            f"ELSE '' END || format('{{:x}}', {n} % 65536)")


BASE = f"""
size AS (SELECT count(*) AS n FROM supplier),
server AS (
  SELECT s_suppkey AS s, 'ns' || s_suppkey || '.dns.example.' AS domain,
         s_suppkey % 10 = 9 AS missing, s_suppkey % 3 = 0 AS has_v6,
         '10.' || (s_suppkey // 50000) || '.' || (s_suppkey % 250) || '.'
           || (53 + (s_suppkey // 250) % 200) AS v4,
         {_v6('2001:db8', 's_suppkey')} AS v6
  FROM supplier),
zone AS (
  SELECT c_custkey AS c, 'z' || c_custkey || '.example.' AS domain, 300 + c_custkey % 60 AS ttl,
         'ns' || (c_custkey % n) || '.dns.example.' AS ns1,
         CASE WHEN c_custkey % 5 <> 0 THEN 'ns' || ((7 * c_custkey + 1) % n) || '.dns.example.' END
           AS ns2
  FROM customer, size),
zone_ns AS (
  SELECT c, domain, ttl, 1 AS pos, ns1 AS ns FROM zone
  UNION ALL SELECT c, domain, ttl, 2, ns2 FROM zone WHERE ns2 IS NOT NULL),
host AS (
  SELECT o_orderkey AS o, o_orderkey % 8 AS kind, 60 + o_orderkey % 240 AS ttl, o_custkey AS z,
         'h' || o_orderkey || '.z' || o_custkey || '.example.' AS domain, o_orderstatus AS status
  FROM orders),
https AS (
  SELECT domain, o, ttl, (o // 8) % 6 AS shape, format('{{:08X}}', o) AS digits,
         CASE WHEN o >= 65536 THEN format('{{:x}}', o // 65536) || ':' ELSE '' END
           || format('{{:x}}', o % 65536) AS low,
         '10.' || ((o // 65536) % 256) || '.' || ((o // 256) % 256) || '.' || (o % 256) AS hint
  FROM host WHERE kind = 6),
https_text AS (
  SELECT *, CASE shape
    WHEN 0 THEN 'SVCB(priority=1, target=., params=[alpn="h2", ipv4hint="' || hint || '"])'
    WHEN 1 THEN 'SVCB(priority=1, target=svc' || o || '.example, params=[key3=0x01BB])'
    WHEN 2 THEN 'SVCB(priority=1, target=., params=[ipv6hint="2001:db8::' || low || '"])'
    WHEN 3 THEN 'SVCB(priority=1, target=., params=[echconfig=0x' || digits || '])'
    WHEN 4 THEN 'SVCB(priority=1, target=., params=[])'
    ELSE 'SVCB(priority=16, target=., params=[alpn="h3,h2", key7=0x2F71])' END AS value
  FROM https),
txt AS (
  SELECT c, domain, ttl, CASE c % 6 WHEN 0 THEN '"v=spf1 -all"'
    WHEN 1 THEN '"v=spf1 include:z' || c || ' ~all"'
    WHEN 2 THEN '"site-verification=' || c || '"' WHEN 3 THEN '"v=spf1 a mx -all"' END AS value
  FROM zone WHERE c % 6 <= 3),
rec AS (
  SELECT domain, 'A' AS rtype, 300 AS ttl, 'glue' AS attribute,
         CASE WHEN missing THEN 'nxrrset' ELSE '' END AS rcode,
         CASE WHEN missing THEN '' ELSE v4 END AS rdata, NULL AS priority, 1 AS pos FROM server
  UNION ALL SELECT domain, 'AAAA', 300, 'glue', '', v6, NULL, 1 FROM server WHERE has_v6
  UNION ALL SELECT domain, 'NS', ttl, 'authanswer', '', ns, NULL, pos FROM zone_ns
  UNION ALL SELECT domain, 'MX', ttl, 'authanswer', '', 'mx' || c || '.example.', 10, 1
            FROM zone WHERE c % 4 = 1
  UNION ALL SELECT domain, 'MX', ttl, 'authanswer', 'nxrrset', '', 0, 1 FROM zone WHERE c % 4 = 2
  UNION ALL SELECT domain, 'TXT', ttl, 'authanswer', '', value, NULL, 1 FROM txt WHERE c % 6 <> 3
  UNION ALL SELECT domain, 'A', ttl, 'answer', '', '198.51.100.' || (o % 250), NULL, 1
            FROM host WHERE kind <= 1
  UNION ALL SELECT domain, 'AAAA', ttl, 'answer', '', {_v6('2001:db8:1', 'o')}, NULL, 1
            FROM host WHERE kind = 1
  UNION ALL SELECT domain, 'CNAME', ttl, 'answer', '', 'z' || z || '.example.', NULL, 1
            FROM host WHERE kind = 2
  UNION ALL SELECT domain, 'AAAA', ttl, 'answer', 'nxrrset', '', NULL, 1 FROM host WHERE kind = 3
  UNION ALL SELECT domain, 'ANY', ttl, 'answer', 'nxdomain', '', NULL, 1 FROM host WHERE kind = 4
  UNION ALL SELECT domain, 'PTR', ttl, 'answer', '', 'p' || o || '.example.', NULL, 1
            FROM host WHERE kind = 5
  UNION ALL SELECT domain, 'TYPE65', ttl, 'answer', '', value, NULL, 1 FROM https_text
  UNION ALL SELECT domain, 'TYPE65', ttl, 'answer', 'nxrrset', '', NULL, 1
            FROM host WHERE kind = 7),
owner AS (SELECT domain FROM server UNION ALL SELECT domain FROM zone
          UNION ALL SELECT domain FROM host),
item AS (
  SELECT domain, rtype, pos, CASE
    WHEN rtype = 'NS' THEN '{{' || rdata || ' ' || ttl || '  ' || attribute || '}}'
    WHEN rcode <> '' THEN '{{TTL=' || ttl || ', Rcode=' || rcode || ', Attribute=' || attribute || '}}'
    WHEN rtype = 'MX' THEN '{{TTL=' || ttl || ', Priority=' || priority || ', MailServer=' || rdata
      || ', Attribute=' || attribute || '}}'
    ELSE '{{TTL=' || ttl || ', ' || CASE rtype WHEN 'PTR' THEN 'Target' WHEN 'TXT' THEN 'Content'
      ELSE 'IP' END || '=' || rdata || ', Attribute=' || attribute || '}}' END AS text
  FROM rec),
detail AS (
  SELECT o.domain,
    {" || ".join(
        f"'{'' if name == 'NSs' else ',' if name == 'TYPE64' else ', '}{name}: [' || "
        f"coalesce(string_agg(i.text, ' ' ORDER BY i.pos) FILTER (i.rtype = '{t}'), '') || ']'"
        for name, t in (("NSs", "NS"), ("As", "A"), ("AAAAs", "AAAA"), ("ANY", "ANY"),
                        ("TYPE65", "TYPE65"), ("TYPE64", "TYPE64"), ("CNAME", "CNAME"),
                        ("MX", "MX"), ("PTR", "PTR"), ("TXT", "TXT")))} AS detail
  FROM owner o LEFT JOIN item i ON i.domain = o.domain GROUP BY o.domain),
neg AS (SELECT DISTINCT domain, rcode FROM rec WHERE rcode <> ''),
address AS (
  SELECT z.c, z.domain, z.ns, 'A' AS rtype, CASE WHEN missing THEN '' ELSE v4 END AS ip
  FROM zone_ns z JOIN server s ON s.domain = z.ns
  UNION ALL
  SELECT z.c, z.domain, z.ns, 'AAAA', v6 FROM zone_ns z JOIN server s ON s.domain = z.ns
  WHERE has_v6)
"""

RANGES = f"""
span AS (  -- IPv4 entries as first and last address; prefix for CIDR entries
  SELECT n_name AS client, 167772160 + 2560 * n_nationkey AS lo,
         167772160 + 2560 * n_nationkey + 1279 AS hi, NULL AS plen FROM nation
  UNION ALL SELECT n_name, 167772160 + 2560 * n_nationkey + 1280,
         167772160 + 2560 * n_nationkey + 1535, 24 FROM nation
  UNION ALL SELECT 'BACKBONE', 167804928, 167837695, 17
  UNION ALL SELECT 'PART' || p_partkey, base + p_partkey % 200,
         base + p_partkey % 200 + (p_partkey * 7) % 56, NULL
  FROM (SELECT p_partkey, 2886729728 + 65536 * (p_partkey % 16) + 256 * ((p_partkey // 16) % 256)
          AS base FROM part)),
v6span AS (
  SELECT 'V6POOL' AS client, '2001:db8::/32' AS network, NULL AS ip, 32 AS plen
  UNION ALL SELECT 'SUPPLIER' || s, CASE WHEN s = 0 THEN '2001:db8::' ELSE v6 END || '/128', v6, 128
  FROM server WHERE s % 6 = 0),
network AS (  -- every address of a range, in the largest aligned block of the range around it
  SELECT DISTINCT client, lo, hi, a - a % (1 << b) AS net, 32 - b AS plen FROM (
    SELECT client, lo, hi, a, max(b) AS b FROM (
      SELECT client, lo, hi, unnest(range(lo, hi + 1)) AS a FROM span WHERE plen IS NULL) x,
      range(0, 33) AS sizes(b)
    WHERE a - a % (1 << b) >= lo AND a - a % (1 << b) + (1 << b) - 1 <= hi
    GROUP BY client, lo, hi, a)
  UNION ALL SELECT client, lo, hi, lo, plen FROM span WHERE plen IS NOT NULL),
ns_ip AS (SELECT DISTINCT ip FROM address),
v4_ip AS (
  SELECT ip, CAST(split_part(ip, '.', 1) AS BIGINT) * 16777216
    + CAST(split_part(ip, '.', 2) AS BIGINT) * 65536
    + CAST(split_part(ip, '.', 3) AS BIGINT) * 256 + CAST(split_part(ip, '.', 4) AS BIGINT) AS a
  FROM ns_ip WHERE ip LIKE '%.%'),
hit AS (
  SELECT ip, client, plen FROM v4_ip JOIN network ON a BETWEEN net AND net + (1 << (32 - plen)) - 1
  UNION ALL SELECT i.ip, client, plen FROM ns_ip i, v6span v
  WHERE i.ip LIKE '%:%' AND (v.ip IS NULL OR v.ip = i.ip)),
owned AS (
  SELECT i.ip, coalesce(max_by(client, plen), '未知') AS client, max(plen) AS plen,
         count(client) AS n_matches
  FROM ns_ip i LEFT JOIN hit h ON h.ip = i.ip GROUP BY i.ip),
ownership AS (
  SELECT o.client, a.ip, count(*) AS n_domains, CASE WHEN count(*) > 50 THEN '过长不显示'
    ELSE string_agg(a.domain, '|' ORDER BY a.domain) END AS domains
  FROM address a JOIN owned o ON o.ip = a.ip GROUP BY o.client, a.ip)
"""

RESPONSES = """
asked AS (
  SELECT c, domain, ns1, ns2, '10.9.' || (c % 250) || '.1' AS a1, '10.9.' || (c % 250) || '.2' AS a2,
         'www.' || domain AS www, c % 19 = 0 OR c % 23 = 0 AS lost,
         ns2 IS NOT NULL AND c % 13 <> 0 AS heard FROM zone),
gone AS (
  SELECT h.o, h.domain, z.ns1, CASE WHEN z.ns2 IS NULL THEN z.ns1 ELSE z.ns1 || ',' || z.ns2 END
           AS parents, z.ns2 IS NOT NULL AS two,
         h.o % 24 = 12 AS soa, h.o % 48 = 20 AS aliased, h.o % 48 = 44 AS silent
  FROM host h JOIN zone z ON z.c = h.z WHERE h.kind = 4),
target AS (SELECT DISTINCT o % 100 AS t FROM gone WHERE aliased),
resp AS (
  SELECT '192.0.2.53' AS server, domain AS qname, 1 AS attempt, true AS answered,
         CASE WHEN status = 'P' THEN 2 ELSE 0 END AS rcode,
         CASE WHEN status = 'F' THEN '198.51.100.' || (o % 250) ELSE '' END AS a, '' AS cname,
         o % 500 AS ms
  FROM host WHERE kind IN (3, 7) AND o % 40 <> 3
  UNION ALL SELECT '192.0.2.53', domain, 1, NOT lost, 0, CASE WHEN lost THEN '' ELSE a1 END, '',
         c % 300 FROM asked
  UNION ALL SELECT '192.0.2.53', domain, 2, c % 23 <> 0, 0, CASE WHEN c % 23 = 0 THEN '' ELSE a1 END,
         '', c % 300 FROM asked WHERE lost
  UNION ALL SELECT ns1, domain, 1, true, 0, a1, '', c * 3 % 200 FROM asked
  UNION ALL SELECT ns2, domain, 1, true, 0,
         CASE WHEN c % 17 = 0 THEN '' WHEN c % 11 = 0 THEN a2 ELSE a1 END,
         CASE WHEN c % 17 = 0 THEN www ELSE '' END, c * 3 % 200 FROM asked WHERE heard
  UNION ALL SELECT ns2, www, 1, true, 0, CASE WHEN c % 11 = 0 THEN a2 ELSE a1 END, '', 0
         FROM asked WHERE heard AND c % 17 = 0
  UNION ALL SELECT '192.0.2.53', '.', 1, true, 0, '', '', 0
  UNION ALL SELECT 'a.root.example.', domain, 1, true, 0, '', '', 0 FROM gone
  UNION ALL SELECT ns1, domain, 1, true, CASE WHEN soa THEN 3 ELSE 0 END,
         CASE WHEN soa OR aliased THEN '' ELSE '203.0.113.' || (o % 250) END,
         CASE WHEN aliased THEN 't' || (o % 100) || '.target.example.' ELSE '' END, 0
         FROM gone WHERE NOT silent
  UNION ALL SELECT 'a.root.example.', 't' || t || '.target.example.', 1, true, 0, '', '', 0 FROM target
  UNION ALL SELECT 'ns0.dns.example.', 't' || t || '.target.example.', 1, true, 0,
         '203.0.113.' || t, '', 0 FROM target),
failing AS (
  SELECT n.domain, CASE WHEN r.answered IS NULL OR NOT r.answered THEN '无响应'
    WHEN r.rcode = 2 THEN 'SERVFAIL' END AS status
  FROM neg n LEFT JOIN resp r ON r.qname = n.domain AND r.server = '192.0.2.53' AND r.attempt = 1
  WHERE n.rcode = 'nxrrset' AND (r.answered IS NULL OR NOT r.answered OR r.rcode = 2)),
differ AS (
  SELECT * FROM (
    SELECT a.c, a.domain, z.pos, z.ns, CASE WHEN a.c % 23 = 0 THEN '' ELSE a.a1 END AS expected_a,
           CASE WHEN z.pos = 1 THEN a.a1 WHEN NOT heard THEN '' WHEN a.c % 11 = 0 THEN a.a2
             ELSE a.a1 END AS actual_a
    FROM asked a JOIN zone_ns z ON z.c = a.c) WHERE expected_a <> actual_a),
traced AS (
  SELECT domain, CASE WHEN soa THEN '' WHEN aliased THEN '203.0.113.' || (o % 100)
           ELSE '203.0.113.' || (o % 250) END AS addresses,
         CASE WHEN soa THEN '' WHEN aliased THEN 'ns0.dns.example.' WHEN o % 16 = 4 THEN ns1
           ELSE parents END AS child_ns,
         CASE WHEN aliased THEN 'ns0.dns.example.' ELSE parents END AS parent_ns,
         two AND o % 16 = 4 AND NOT soa AND NOT aliased AS mismatch, soa
  FROM gone WHERE NOT silent)
"""


def _sql(select: str, *more: str) -> str:
    return f"WITH {', '.join(part.strip() for part in (BASE, *more))}\n{select.strip()}"


def _report(source: str) -> str:
    return _sql(f"SELECT domain, value FROM {source}")


SPF = "(SELECT domain, value FROM txt WHERE c % 6 <= 1)"
TXT = "(SELECT domain, value FROM txt WHERE c % 6 <= 2)"
MX = "(SELECT domain, '10 mx' || c || '.example.' AS value FROM zone WHERE c % 4 = 1)"
PTR = "(SELECT domain, 'p' || o || '.example.' AS value FROM host WHERE kind = 5)"
TYPE64 = "(SELECT domain, '' AS value FROM host WHERE kind = 7)"

PARAMS = """
param AS (
  SELECT domain, 0 AS pos, 1 AS key, '026832' AS value_hex, 'alpn="h2"' AS text,
         'alpn="h2"' AS strict, NULL AS violation FROM https WHERE shape = 0
  UNION ALL SELECT domain, 1, 4, '0A' || substr(digits, 3), 'ipv4hint="' || hint || '"',
         'ipv4hint="' || hint || '"', NULL FROM https WHERE shape = 0
  UNION ALL SELECT domain, 0, 3, '01BB', 'key3=0x01BB', 'key=0x0003, value=0x01BB', NULL
         FROM https WHERE shape = 1
  UNION ALL SELECT domain, 0, 6, '20010DB80000000000000000' || digits,
         'ipv6hint="2001:db8::' || low || '"', 'ipv6hint="2001:db8::' || low || '"', NULL
         FROM https WHERE shape = 2
  UNION ALL SELECT domain, 0, 5, digits, 'echconfig=0x' || digits,
         'key=0x0005, value=0x' || digits, NULL FROM https WHERE shape = 3
  UNION ALL SELECT domain, 0, 1, '056832', NULL, NULL, 'ALPN格式错误: 字符串长度不足'
         FROM https WHERE shape = 4
  UNION ALL SELECT domain, 1, 4, '0A0000', NULL, NULL, 'IPv4Hint长度必须是4的倍数'
         FROM https WHERE shape = 4
  UNION ALL SELECT domain, 0, 1, '026833026832', 'alpn="h3,h2"', 'alpn="h3,h2"', NULL
         FROM https WHERE shape = 5
  UNION ALL SELECT domain, 1, 7, '2F71', 'key7=0x2F71', 'key=0x0007, value=0x2F71', NULL
         FROM https WHERE shape = 5)
"""

STITCHED = """
SELECT domain, ttl, 'answer' AS attribute, CASE shape
  WHEN 0 THEN '0001000001000302683200040004' || '0A' || substr(digits, 3)
  WHEN 1 THEN '0001' || format('{:02X}', length('svc' || o)) || hex(encode('svc' || o))
    || '07' || hex(encode('example')) || '000003000201BB'
  WHEN 2 THEN '0001000006001020010DB80000000000000000' || digits
  WHEN 3 THEN '00010000050004' || digits
  WHEN 4 THEN '0001000001000305683200040003' || '0A0000'
  ELSE '00100000010006026833026832000700022F71' END AS hex
FROM https
"""

LOOKUP = """
probe AS (SELECT DISTINCT domain FROM (
  SELECT regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1) AS domain FROM pages
  UNION ALL SELECT domain FROM zone))
"""

GATE = """
SELECT true AS in_cache, CAST(7 + (SELECT n FROM size)
    + (SELECT count(*) FROM server WHERE has_v6)
    + (SELECT count(*) + count(ns2) + count(*) FILTER (c % 4 IN (1, 2))
         + count(*) FILTER (c % 6 <= 3) FROM zone)
    + (SELECT count(*) + count(*) FILTER (kind IN (1, 7)) + 2 * count(*) FILTER (kind = 6) FROM host)
  AS BIGINT) AS n_lines
UNION ALL SELECT false, 6 + 2 * (SELECT count(*) FROM part)
"""

CARRY = """
SELECT 'glue' AS attribute, count(*) + count(*) FILTER (has_v6) AS n_lines FROM server
UNION ALL SELECT 'authanswer', count(*) + count(ns2) + count(*) FILTER (c % 4 IN (1, 2))
  + count(*) FILTER (c % 6 <= 3) FROM zone
UNION ALL SELECT 'answer', count(*) + count(*) FILTER (kind IN (1, 7))
  + 2 * count(*) FILTER (kind = 6) FROM host
"""

INHERIT = """
SELECT domain AS owner, 1 + CASE WHEN has_v6 THEN 1 ELSE 0 END AS n_lines FROM server
UNION ALL SELECT domain, 1 + CASE WHEN ns2 IS NULL THEN 0 ELSE 1 END
  + CASE WHEN c % 4 IN (1, 2) THEN 1 ELSE 0 END + CASE WHEN c % 6 <= 3 THEN 1 ELSE 0 END FROM zone
UNION ALL SELECT domain, 1 + CASE WHEN kind IN (1, 7) THEN 1 WHEN kind = 6 THEN 2 ELSE 0 END FROM host
"""

SIZES = f"""
SELECT 'spf' AS report, count(*) AS n FROM {SPF} UNION ALL SELECT 'txt', count(*) FROM {TXT}
UNION ALL SELECT 'mx', count(*) FROM {MX} UNION ALL SELECT 'ptr', count(*) FROM {PTR}
UNION ALL SELECT 'https', count(*) FROM https UNION ALL SELECT 'type64', 0
UNION ALL SELECT 'ns_ip', count(DISTINCT ip) FROM address
"""

NORMALISED = f"""
SELECT '192.0.2.53' AS server, domain AS qname,
  CASE WHEN v6 AND NOT mx AND c % 5 = 0 THEN 2 ELSE 0 END AS rcode,
  '10.9.' || (c % 250) || '.1' || CASE WHEN c % 3 = 0 THEN ',10.9.' || (c % 250) || '.2' ELSE '' END
    AS rr_a,
  CASE WHEN v6 AND c % 5 <> 0 THEN {_v6('2001:db8', 'c')} ELSE '' END AS rr_aaaa,
  CASE WHEN mx THEN '10 mx' || c || '.example.' ELSE '' END AS rr_mx,
  300 + c % 60 + CASE WHEN c % 3 = 0 THEN 1 ELSE 0 END AS ttl_a,
  ns1 || CASE WHEN v6 AND c % 5 = 0 THEN ',soa.example.' ELSE '' END AS auth_ns,
  CASE WHEN v6 AND c % 5 = 0 THEN 'SOA' ELSE 'NS' END AS auth_type
FROM (SELECT *, c % 4 <> 0 AS v6, c % 4 <> 0 AND c % 7 <> 0 AS mx FROM zone)
"""

CHASED = """
SELECT r.server, r.qname, CASE WHEN r.cname = '' THEN 0 ELSE 1 END AS hops,
  CASE WHEN r.cname = '' THEN r.a ELSE coalesce(t.a, '') END AS rr_a, '' AS rr_cname
FROM resp r LEFT JOIN resp t ON t.server = r.server AND t.qname = r.cname
WHERE r.answered AND r.attempt = 1
"""

COUNTS = """
SELECT 'failing_negatives' AS "check", (SELECT count(*) FROM failing) AS hits,
  (SELECT count(*) FROM neg WHERE rcode = 'nxrrset') AS total
UNION ALL SELECT 'parent_child_mismatch', (SELECT count(*) FROM traced WHERE mismatch),
  (SELECT count(*) FROM neg WHERE rcode = 'nxdomain')
UNION ALL SELECT 'ns_disagreement', (SELECT count(DISTINCT domain) FROM differ),
  (SELECT count(*) FROM zone)
"""

FILES = f"""
SELECT 'spf' AS report, domain || '|' || value AS line FROM {SPF}
UNION ALL SELECT 'txt', domain || '|' || value FROM {TXT}
UNION ALL SELECT 'mx', domain || '|' || value FROM {MX}
UNION ALL SELECT 'ptr', domain || '|' || value FROM {PTR}
UNION ALL SELECT 'https', domain || '|' || value FROM https_text
UNION ALL SELECT 'type64', domain || '|' || value FROM {TYPE64}
UNION ALL SELECT 'ns_ip', ip FROM (SELECT DISTINCT ip FROM address)
"""

BLOCKS = """
odd AS (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY pos) AS place FROM differ)
SELECT domain, 0 AS place,
  domain || ' NS不一致：ns（192.0.2.53）结果-[' || any_value(expected_a) || ']-[]' AS line
FROM odd GROUP BY domain
UNION ALL SELECT domain, place,
  repeat(' ', length(domain) + 10) || 'ns（' || ns || '）结果-[' || actual_a || ']-[]' FROM odd
UNION ALL SELECT domain, max(place) + 1, '' FROM odd GROUP BY domain
"""

NESTED = "SELECT o.domain, " + ", ".join(
    f"""coalesce(string_agg(concat_ws(' ', ttl, attribute, rcode, rdata, priority), ','
      ORDER BY pos) FILTER (rtype = '{t}'), '') AS "{name}" """
    for name, t in (("NSs", "NS"), ("As", "A"), ("AAAAs", "AAAA"), ("ANY", "ANY"),
                    ("TYPE65", "TYPE65"), ("TYPE64", "TYPE64"), ("CNAME", "CNAME"), ("MX", "MX"),
                    ("PTR", "PTR"), ("TXT", "TXT"))
) + " FROM owner o LEFT JOIN rec r ON r.domain = o.domain GROUP BY o.domain"

RECORD_COLUMNS = "domain, rtype, ttl, attribute, rcode, rdata, priority"

ORACLES: dict[str, str] = {
    "dump_records": _sql(f"SELECT {RECORD_COLUMNS} FROM rec"),
    "dump_parse": _sql("SELECT rtype, rcode, count(*) AS n_records FROM rec GROUP BY rtype, rcode"),
    "section_gate": _sql(GATE),
    "attribute_carry": _sql(CARRY),
    "owner_inherit": _sql(INHERIT),
    "stitched_values": _sql(STITCHED),
    "negative_records": _sql(
        "SELECT domain, rtype, ttl, attribute, rcode FROM rec WHERE rcode <> ''"),
    "domain_registry": _sql("SELECT domain FROM owner"),
    "cache_summary": _sql("""
        SELECT (SELECT count(*) FROM owner) AS domains,
               count(*) FILTER (rcode = 'nxdomain') AS nxdomain,
               count(*) FILTER (rcode = 'nxrrset') AS nxrrset FROM neg"""),
    "negative_domains": _sql("SELECT domain, rcode FROM neg"),
    "domain_lookup": _sql("""
        SELECT domain, true AS found,
               'Domain (' || domain || '): ' || detail AS text
        FROM detail WHERE domain = 'z1.example.'"""),
    "bulk_lookup": _sql("""
        SELECT p.domain, d.domain IS NOT NULL AS found,
               CASE WHEN d.domain IS NULL THEN '未找到域名: ' || p.domain
                 ELSE 'Domain (' || p.domain || '): ' || detail END AS text
        FROM probe p LEFT JOIN detail d ON d.domain = p.domain""", LOOKUP),
    "domain_ns": _report(
        "(SELECT domain, string_agg(ns, ',' ORDER BY pos) AS value FROM zone_ns GROUP BY domain)"),
    "record_detail": _sql("SELECT domain, detail FROM detail"),
    "nested_records": _sql(NESTED),
    "https_report": _sql("SELECT domain, value FROM https_text"),
    "type64_report": _sql(f"SELECT domain, value FROM {TYPE64}"),
    "svcb_params": _sql("""
        SELECT p.domain, CASE WHEN shape = 5 THEN 16 ELSE 1 END AS priority,
               CASE WHEN shape = 1 THEN 'svc' || o || '.example' ELSE '.' END AS target,
               pos, key, value_hex, text FROM param p JOIN https h ON h.domain = p.domain""", PARAMS),
    "svcb_violations": _sql("SELECT domain, pos, key, strict, violation FROM param", PARAMS),
    "ptr_report": _report(PTR),
    "txt_report": _report(TXT),
    "spf_report": _report(SPF),
    "spf_report_relaxed": _report("(SELECT domain, value FROM txt WHERE c % 6 <> 2)"),
    "mx_report": _report(MX),
    "single_ns": _sql("""
        SELECT domain, '{' || ns1 || ' ' || ttl || '  authanswer}' AS ns FROM zone
        WHERE ns2 IS NULL"""),
    "single_ns_count": _sql("SELECT count(*) AS n_domains FROM zone WHERE ns2 IS NULL"),
    "report_sizes": _sql(SIZES),
    "ns_address_join": _sql("SELECT domain, ns, rtype, ip FROM address"),
    "ns_ip_list": _sql("SELECT DISTINCT ip FROM address"),
    "ns_ip_domains": _sql("""
        SELECT ip, count(*) OVER (PARTITION BY ip) AS n_domains, domain FROM address"""),
    "ip_ranges": _sql("""
        SELECT client, 4 AS family, (net // 16777216) || '.' || ((net // 65536) % 256) || '.'
          || ((net // 256) % 256) || '.' || (net % 256) || '/' || plen AS network, plen FROM network
        UNION ALL SELECT client, 6, network, plen FROM v6span""", RANGES),
    "ip_attribution": _sql("SELECT ip, client, plen, n_matches FROM owned", RANGES),
    "ns_ip_ownership": _sql("SELECT client, ip, n_domains, domains FROM ownership", RANGES),
    "probe_status": _sql("""
        SELECT server, qname, attempt, CASE WHEN NOT answered THEN '无响应'
          WHEN rcode = 2 THEN 'SERVFAIL' WHEN rcode = 3 THEN 'NXDOMAIN'
          WHEN a = '' AND cname = '' THEN 'NODATA' ELSE 'NOERROR' END AS status FROM resp""",
        RESPONSES),
    "probe_latency": _sql("""
        SELECT server, qname, attempt, CASE WHEN answered THEN ms ELSE 0 END AS latency_ms
        FROM resp""", RESPONSES),
    "response_normalise": _sql(NORMALISED),
    "failing_negatives": _sql("SELECT status, domain FROM failing", RESPONSES),
    "bag_equal": """
        SELECT doc_id, list_sort(string_split(text, ' '))
          = list_sort(string_split(replace(text, '.', ''), ' ')) AS equal FROM documents""",
    "bounded_contains": """
        SELECT doc_id, len(inside) <= len(words) AND list_has_all(words, inside) AS contained
        FROM (SELECT doc_id, string_split(text, ' ') AS words,
                     string_split(replace(text, '.', ''), ' ') AS inside FROM documents)""",
    "either_containment": """
        SELECT doc_id, one_way, one_way OR other AS either
        FROM (SELECT *, len(inside) <= len(words) AND list_has_all(words, inside) AS other,
                     len(words) <= len(inside) AND list_has_all(inside, words) AS one_way
              FROM (SELECT doc_id, string_split(text, ' ') AS words,
                           string_split(replace(text, '.', ''), ' ') AS inside FROM documents))""",
    "captured_files": _sql("""
        SELECT server, count(*) AS n_probes, count(*) FILTER (WHERE answered) AS n_answered,
               CAST(sum((a <> '')::INT + (cname <> '')::INT) AS BIGINT) AS n_answers
        FROM resp GROUP BY server""", RESPONSES),
    "deep_traces": """
        SELECT 'd' || p || '.deep.example.' AS domain, '203.0.113.' || (p % 250) AS addresses,
               'ns' || h || '.deep.example.' AS child_ns,
               CASE WHEN h = 1 THEN 'a.root.example.' ELSE 'ns' || (h - 1) || '.deep.example.' END
                 AS parent_ns
        FROM (SELECT p_partkey AS p, p_partkey % 12 + 1 AS h FROM part) WHERE h <= 10
        UNION ALL SELECT 'a' || p_partkey || '-0.deep.example.', '203.0.113.' || (p_partkey % 250),
               '', 'a.root.example.' FROM part WHERE p_partkey % 13 <= 10""",
    "deep_answers": """
        SELECT 'd' || p_partkey || '.deep.example.' AS domain,
               '203.0.113.' || (p_partkey % 250) AS addresses FROM part
        UNION ALL SELECT 'a' || p_partkey || '-0.deep.example.', '203.0.113.' || (p_partkey % 250)
        FROM part WHERE p_partkey % 13 <= 10""",
    "deep_chase": """
        SELECT 'c' || p || '-0.deep.example.' AS qname, CAST(least(n, 5) AS INTEGER) AS hops,
               CASE WHEN n <= 5 THEN '203.0.113.' || (p % 250) ELSE '' END AS rr_a,
               CASE WHEN n <= 5 THEN '' ELSE 'c' || p || '-6.deep.example.' END AS rr_cname
        FROM (SELECT p_partkey AS p, p_partkey % 7 AS n FROM part)
        UNION ALL SELECT 'r' || p_partkey || '.deep.example.', 5, '',
               'r' || p_partkey || '.deep.example.' FROM part WHERE p_partkey % 5 = 0""",
    "cname_chase": _sql(CHASED, RESPONSES),
    "ns_disagreement": _sql("""
        SELECT domain, ns, expected_a, actual_a, '' AS actual_cname FROM differ""", RESPONSES),
    "delegation_trace": _sql(
        "SELECT domain, addresses, child_ns, parent_ns FROM traced", RESPONSES),
    "trace_answers": _sql("SELECT domain, addresses FROM traced WHERE NOT soa", RESPONSES),
    "parent_child_mismatch": _sql(
        "SELECT domain, child_ns, parent_ns FROM traced WHERE mismatch", RESPONSES),
    "check_counts": _sql(COUNTS, RESPONSES),
    "report_files": _sql(FILES),
    "written_sizes": _sql(f"SELECT report, count(*) AS n FROM ({FILES}) GROUP BY report"),
    "ownership_file": _sql("""
        SELECT 'NS IP归属,NS IP,解析域名数,域名清单' AS line
        UNION ALL SELECT client || ',' || ip || ',' || n_domains || ',' || domains FROM ownership""",
        RANGES),
    "failing_file": _sql("SELECT status || '|' || domain AS line FROM failing", RESPONSES),
    "parent_child_file": _sql("""
        SELECT domain || '|[' || replace(child_ns, ',', ' ') || ']|[' || replace(parent_ns, ',', ' ')
          || ']' AS line FROM traced WHERE mismatch""", RESPONSES),
    "ns_disagreement_file": _sql(BLOCKS.split("\n", 2)[2], RESPONSES, BLOCKS.split("\n", 2)[1]),
}
