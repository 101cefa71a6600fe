"""Web addresses in canonical form, parsed and put together in column expressions.

``parsed`` reads an http(s) address the way browsers do: scheme and host in lower
case, percent-encoded and international host names as ASCII, IPv4 addresses from
any of their numeric spellings, IPv6 addresses in their shortest form, default
ports left out, the steps "." and ".." of the path taken, and what may not stand
in a path, query or fragment percent-encoded.  Everything is an expression of the
JVM; international names go through ``java.net.IDN``.

Not addresses, and null: other schemes, an empty or impossible host or port.  Host
names with letters that the two standards of international names write differently
(sharp s, final sigma, joiners) are taken for impossible.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillspark.functions.dates import missing
from quillspark.functions.text import let

#: What the parts may not hold as it is, beside all that is not ASCII.
PATH_MARKS, QUERY_MARKS, FRAGMENT_MARKS = "\"<>`{}", "\"'<>", "\"<>`"
#: What no host may hold.
HOST_MARKS = "\\x00-\\x20#%/:<>?@\\[\\\\\\]^|\\x7F"
#: Letters that the standards of international names treat differently.
_DEVIATIONS = "[ßςẞ‌‍]"


def decoded(c: Column) -> Column:
    """Percent signs decoded; a plus stays a plus; null if malformed."""
    return F.try_url_decode(F.replace(c, F.lit("+"), F.lit("%2B")))


def _encoded(c: Column, marks: str) -> Column:
    """The marks, blanks, controls and everything beyond ASCII percent-encoded."""
    odd = "[" + "".join("\\" + m for m in marks) + "\\x00-\\x20]|[^\\x00-\\x7E]+"
    found = F.transform(F.regexp_extract_all(c, F.lit(odd), F.lit(0)), lambda x: F.replace(F.url_encode(x), F.lit("+"), F.lit("%20")))
    joined = F.array_join(F.zip_with(F.split(c, odd), found, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    return F.when(c.rlike(odd), joined).otherwise(c)


def _number(part: Column) -> Column:
    """A part of an IPv4 address: decimal, octal or hexadecimal; null if none."""
    wide = F.length(part) > 18
    return F.when(wide, F.lit(None).cast("long")).otherwise(
        F.when(part.rlike("^0[xX][0-9a-fA-F]*$"), F.coalesce(F.conv(missing(F.substring(part, F.lit(3), F.length(part))), 16, 10), F.lit("0")))
        .when(part.rlike("^0[0-7]+$"), F.conv(part, 8, 10))
        .when(part.rlike("^(?:0|[1-9][0-9]*)$"), part)
        .try_cast("long")
    )


def _ipv4(host: Column) -> Column:
    """Four dotted numbers from one to four parts, the last of which fills the rest."""
    named = F.split(F.regexp_replace(host, "[.]$", ""), "[.]")

    def made(numbers: Column) -> Column:
        n = F.size(numbers)
        last = F.element_at(numbers, -1)
        head = F.slice(numbers, F.lit(1), n - 1)
        room = F.element_at(F.array(*[F.lit(256**k) for k in (4, 3, 2, 1)]), F.least(F.greatest(n, F.lit(1)), F.lit(4)))
        ok = (n <= 4) & F.forall(numbers, lambda x: x.isNotNull()) & F.forall(head, lambda x: x < 256) & (last < room)
        value = F.aggregate(head, F.lit(0).cast("long"), lambda a, x: a * 256 + x) * room + last
        parts = [(F.shiftright(value, 8 * k) % 256).cast("string") for k in (3, 2, 1, 0)]
        return F.when(F.coalesce(ok, F.lit(False)), F.concat_ws(".", *parts))

    return let(F.transform(named, _number), made)


def _ipv6(inner: Column) -> Column:
    """The shortest form of the address between brackets, or null."""
    # a dotted end stands for two groups
    dotted = F.regexp_extract(inner, "([0-9]+(?:[.][0-9]+){3})$", 1)
    octets = F.transform(F.split(dotted, "[.]"), lambda x: F.when(x.rlike("^(?:0|[1-9][0-9]{0,2})$"), x.try_cast("int")))
    low = [F.lower(F.hex(F.get(octets, k) * 256 + F.get(octets, k + 1))) for k in (0, 2)]
    fits = F.forall(octets, lambda x: F.coalesce(x < 256, F.lit(False)))
    plain = F.when(dotted == "", F.lower(inner)).when(
        fits, F.concat(F.substring(F.lower(inner), F.lit(1), F.length(inner) - F.length(dotted)), low[0], F.lit(":"), low[1])
    )

    def whole(t: Column) -> Column:
        sides = F.split(t, "::")
        gap = F.size(sides) == 2
        groups = lambda x: F.when(x == "", F.array().cast("array<string>")).otherwise(F.split(x, ":"))
        left, right = groups(F.get(sides, 0)), groups(F.coalesce(F.get(sides, 1), F.lit("")))
        zeros = F.lit(8) - F.size(left) - F.size(right)
        ok = F.when(gap, zeros >= 1).otherwise((F.size(sides) == 1) & (zeros == 0))
        full = F.concat(left, F.array_repeat(F.lit("0"), F.greatest(zeros, F.lit(0))), right)
        return F.when(ok & F.forall(full, lambda g: g.rlike("^[0-9a-f]{1,4}$")), full)

    def shortest(full: Column) -> Column:
        bare = F.transform(full, lambda g: F.regexp_replace(g, "^0+(?=.)", ""))
        spelled = F.array_join(bare, ":")

        # the first of the longest runs of two zeros or more
        runs = F.regexp_extract_all(spelled, F.lit("(?<=^|:)0(?::0)+(?=:|$)"), F.lit(0))
        longest = F.array_max(F.transform(runs, lambda r: F.length(r)))
        run = F.get(F.filter(runs, lambda r: F.length(r) == longest), F.lit(0))
        padded = F.concat(F.lit(":"), spelled, F.lit(":"))
        at = F.instr(padded, F.concat(F.lit(":"), run, F.lit(":")))
        before = F.regexp_replace(F.substring(padded, F.lit(1), at - 1), "^:", "")
        after = F.regexp_replace(F.substring(padded, at + F.length(run) + 2, F.length(padded)), ":$", "")
        return F.coalesce(F.concat(before, F.lit("::"), after), spelled)

    return F.concat(F.lit("["), let(let(plain, whole), shortest), F.lit("]"))


def canonical_host(raw: Column) -> Column:
    """The host of an address, or null."""
    name = F.lower(decoded(raw))
    international = name.rlike("[^\\x00-\\x7F]")
    ascii_name = F.when(international & ~name.rlike(_DEVIATIONS), F.lower(F.try_reflect(F.lit("java.net.IDN"), F.lit("toASCII"), name))).when(~international, name)

    def judged(host: Column) -> Column:
        numeric = host.rlike("(?:^|[.])(?:[0-9]+|0x[0-9a-f]*)[.]?$")
        fit = (host != "") & ~host.rlike(f"[{HOST_MARKS}]")
        return F.when(fit, F.when(numeric, _ipv4(host)).otherwise(host))

    six = raw.rlike("^\\[.*\\]$")
    plain = raw.rlike("^[A-Za-z0-9._-]*[A-Za-z]$") & ~raw.rlike("(?i)(?:^|[.])0x[0-9a-f]*$")
    return F.when(plain, F.lower(raw)).when(six, _ipv6(F.substring(raw, F.lit(2), F.length(raw) - 2))).otherwise(let(ascii_name, judged))


def _path(raw: Column) -> Column:
    """The path with its steps taken; it begins with a slash."""
    steps = F.split(raw, "/")
    steps = F.when(raw.startswith("/"), F.slice(steps, F.lit(2), F.size(steps))).otherwise(F.array(F.lit("")))
    is_up = lambda s: F.lower(F.replace(F.lower(s), F.lit("%2e"), F.lit("."))) == ".."
    is_here = lambda s: F.replace(F.lower(s), F.lit("%2e"), F.lit(".")) == "."

    def step(done: Column, s: Column) -> Column:
        return F.when(is_up(s), F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))).when(is_here(s), done).otherwise(F.array_append(done, s))

    def walked(all_: Column) -> Column:
        last = F.element_at(all_, -1)
        kept = F.aggregate(all_, F.array().cast("array<string>"), step)
        open_end = is_up(last) | is_here(last)
        return F.concat(F.lit("/"), F.array_join(F.when(open_end, F.array_append(kept, F.lit(""))).otherwise(kept), "/"))

    taken = F.when(raw.rlike("(?i)/(?:[.]|%2e){1,2}(?:/|$)"), let(steps, walked)).otherwise(F.when(raw == "", F.lit("/")).otherwise(raw))
    return let(taken, lambda t: _encoded(t, PATH_MARKS))


def _named(**fields: Column) -> Column:
    """A struct whose names are arguments: aliases get lost inside some operators."""
    return F.named_struct(*[x for name, c in fields.items() for x in (F.lit(name), c)])


_SPLIT = "(?is)^(https?):[/\\\\]*(?:([^/\\\\?#]*)@)?([^/\\\\?#@]*?)(?::([^:/\\\\?#@\\]]*))?((?:[/\\\\][^?#]*)?)(\\?[^#]*)?(#.*)?$"


def parsed(c: Column) -> Column:
    """struct(scheme, user, host, port, path, query, hash), or null.  ``port``
    is empty where it is the scheme's own, ``query`` and ``hash`` hold their mark."""
    bare = F.regexp_replace(c, "^[\\x00-\\x20]+|[\\x00-\\x20]+$|[\\t\\n\\r]", "")
    names = ("scheme", "user", "host", "port", "path", "query", "hash")
    # one match, its groups parted by a control character that no address holds
    cut = F.split(F.regexp_replace(bare, _SPLIT, "\x02$1\x01$2\x01$3\x01$4\x01$5\x01$6\x01$7"), "\x01")

    def pieces(g: Column) -> Column:
        return F.when(g[0].startswith("\x02"), _named(**{n: g[i] for i, n in enumerate(names)}))

    def whole(p: Column) -> Column:
        number = F.when(p["port"].rlike("^[0-9]{1,18}$"), p["port"].try_cast("long"))
        spelled = F.concat(p["scheme"], F.lit(":"), number)
        port = F.when((p["port"] == "") | spelled.rlike("(?i)https:443$|http:80$"), "").when(number < 65536, number.cast("string"))
        made = _named(
            scheme=F.lower(F.substring(p["scheme"], 2, 5)), user=p["user"], host=canonical_host(p["host"]), port=port, path=_path(F.translate(p["path"], "\\", "/")),
            query=_encoded(p["query"], QUERY_MARKS), hash=_encoded(p["hash"], FRAGMENT_MARKS),
        )
        return let(made, lambda m: F.when(m["host"].isNotNull() & m["port"].isNotNull(), m))

    return let(let(cut, pieces), whole)


def place(parts: Column) -> Column:
    """Scheme, host and port of a parsed address."""
    return F.concat(parts["scheme"], F.lit("://"), parts["host"], F.when(parts["port"] != "", F.concat(F.lit(":"), parts["port"])).otherwise(""))


def href(parts: Column) -> Column:
    """The whole address; credentials come along."""
    user = F.when(parts["user"] != "", F.concat(parts["user"], F.lit("@"))).otherwise("")
    port = F.when(parts["port"] != "", F.concat(F.lit(":"), parts["port"])).otherwise("")
    return F.concat(parts["scheme"], F.lit("://"), user, parts["host"], port, parts["path"], parts["query"], parts["hash"])


def canonical(c: Column) -> Column:
    return let(parsed(c), href)


def parameters(query: Column) -> Column:
    """array of struct(name, value), decoded as a form's fields."""
    pieces = F.filter(F.split(F.substring(query, F.lit(2), F.length(query)), "&"), lambda p: p != "")

    def pair(p: Column) -> Column:
        raw = F.when(p.contains("="), F.substring(p, F.instr(p, "=") + 1, F.length(p))).otherwise("")
        name = F.substring_index(p, "=", 1)
        return _named(name=F.coalesce(F.try_url_decode(name), name), value=F.coalesce(F.try_url_decode(raw), raw))

    return F.transform(pieces, pair)


def query_of(params: Column) -> Column:
    """The query that holds these fields; empty without any."""
    fields = F.transform(params, lambda p: F.concat(F.url_encode(p["name"]), F.lit("="), F.url_encode(p["value"])))
    return F.when(F.size(params) > 0, F.concat(F.lit("?"), F.array_join(fields, "&"))).otherwise("")


#: Names of parameters that only track.
_TRACKING = "(?i)^(?:utm_.+|dgcid|ref)$"


def untracked_query(query: Column) -> Column:
    """Without tracking parameters; a query without any stays as it is."""

    def kept(params: Column) -> Column:
        rest = F.filter(params, lambda p: ~p["name"].rlike(_TRACKING))
        return F.when(F.size(rest) < F.size(params), query_of(rest)).otherwise(query)

    return let(parameters(query), kept)
