"""The texts, types and limits that results depend on."""

# Words that open and close the cache section of a dump.
CACHE_OPENS = "Cache dump of view"
CACHE_CLOSES = ("Address database dump", "Start view")

# Comments that change the attribute of the records after them.
ATTRIBUTES = ("authanswer", "glue", "answer")
NO_ATTRIBUTE = "unknown"

# Record types read from lines with a value, from indented lines, and from negative entries.
POSITIVE_TYPES = (
    "IN NS", "NS", "A", "AAAA", "CNAME", "ANY", "TYPE65", "IN SOA", "SOA",
    "IN MX", "MX", "IN PTR", "PTR", "IN TXT", "TXT",
)
NS_TYPES = ("IN NS", "NS")
NEGATIVE_TYPES = ("A", "AAAA", "CNAME", "ANY", "TYPE65", "MX", "PTR", "TXT")

# Type as written -> type of the record table. Types that are not listed only register a domain.
ROUTES = {
    "IN NS": "NS", "NS": "NS", "A": "A", "AAAA": "AAAA", "CNAME": "CNAME", "ANY": "ANY",
    "IN MX": "MX", "MX": "MX", "PTR": "PTR", "IN TXT": "TXT", "TXT": "TXT", "TYPE65": "TYPE65",
}

# Longest line in bytes, the carriage return included, that a dump or an ownership list may hold.
MAX_DUMP_LINE = 1024 * 1024 - 1
MAX_RANGE_LINE = 64 * 1024 - 1

# Report texts.
UNKNOWN_CLIENT = "未知"
LIST_TOO_LONG = "过长不显示"
LIST_LIMIT = 50
NOT_FOUND = "未找到域名: "
NO_REPLY = "无响应"
OWNERSHIP_HEADER = "NS IP归属,NS IP,解析域名数,域名清单"
NS_DIFFERS = " NS不一致："
NS_RESULT = "ns（%s）结果-%s-%s"
BAD_ALPN = "ALPN格式错误: 字符串长度不足"
BAD_IPV4HINT = "IPv4Hint长度必须是4的倍数"
BAD_IPV6HINT = "IPv6Hint长度必须是16的倍数"

# DNS response codes (IANA registry).
RCODES = {
    0: "NOERROR", 1: "FORMERR", 2: "SERVFAIL", 3: "NXDOMAIN", 4: "NOTIMP", 5: "REFUSED",
    6: "YXDOMAIN", 7: "YXRRSET", 8: "NXRRSET", 9: "NOTAUTH", 10: "NOTZONE", 11: "DSOTYPENI",
    16: "BADSIG", 17: "BADKEY", 18: "BADTIME", 19: "BADMODE", 20: "BADNAME", 21: "BADALG",
    22: "BADTRUNC", 23: "BADCOOKIE",
}

# Limits of the live checks.
CNAME_LIMIT = 5
TRACE_HOPS = 10
TRACE_DEPTH = 10
