"""Column expressions for entity names: paths, addresses, hierarchies, list text."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from traceloom.functions.edge_text import trim_all

# Names that say nothing about an entity.
EMPTY_NAMES = ["datum", "N/A", "},"]

# Ordered rewrites that remove host- and version-specific parts of a name.
HOST_REWRITES = [
    (r"/system32/", "/system/"),
    (r"/syswow64/", "/system/"),
    (r"^system32/", "system/"),
    (r"harddiskvolume\d+", "harddiskvolume"),
    (r"program_files", "program files"),
    (r"common_files", "common files"),
    (r"mozilla_firefox", "mozilla firefox"),
    (r"microsoft_office", "microsoft office"),
    (r"vmware_tools", "vmware tools"),
    (r"windows_sidebar", "windows sidebar"),
    (r"microsoft_shared", "microsoft shared"),
    (r"python\d+", "python"),
    (r"v\d+(\.\d+)+", "v."),
    (r"tcl\d+(\.\d+)?", "tcl."),
    (r"x86_", "x_"),
    (r"x64_", "x_"),
    (r"amd64_", "x_"),
    (r"[0-9a-f]{32}", "bfade..."),
    (r"_[0-9a-f]{16}", "bfade..."),
    (r"_\d+\.\d+\.\d+\.\d+_", "..._"),
]

# Benign keywords searched in node text, per data set kind.
BENIGN_KEYWORDS = {
    "linux_desktop": [
        "netflow", "null", "/dev/pts", "salt-minion.log", "675", "usr", "proc", "/.cache/mozilla/", "tmp",
        "thunderbird", "/bin/", "/sbin/sysctl", "/data/replay_logdb/", "/home/admin/.cache", "/stat", "/boot",
        "qt-opensource-linux-x64", "/eraseme",
    ],
    "windows_desktop": [
        "netflow", "/dev/pts", "salt-minion.log", "null", "usr", "proc", "firefox", "tmp", "thunderbird", "bin/",
        "/data/replay_logdb", "/stat", "/boot", "qt-opensource-linux-x64", "/eraseme", "675",
    ],
    "default": ["netflow", "null", "/dev/pts", "usr", "proc", "tmp"],
}


def slash_path(c: Column) -> Column:
    """Back-slash runs become one slash; slash runs collapse."""
    return F.regexp_replace(F.regexp_replace(c, r"\\+", "/"), "/+", "/")


def is_file_path(path: Column) -> Column:
    """True when the last segment has an extension after a non-dot character."""
    return path.rlike(r"[^./][^/]*\.[^./]*$")


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def long_extension(path: Column) -> Column:
    """The extension to check against the known list, null when it is short enough to keep."""
    ext = F.when(is_file_path(path), F.regexp_extract(path, r"(\.[^./]*)$", 1))
    return F.when(F.length(ext) >= 6, ext)


def drop_digits(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(c, r"\d+$", ""), r"[-_]\d+", ""), r"\d+", "")


def strip_numerics(path: Column, extension_known: Column) -> Column:
    """Remove digits from a slash path, directory by directory.

    ``extension_known`` tells whether ``long_extension`` is on the known list; an
    unknown long extension is cut off. The file name is cleaned only up to its
    first dot.
    """
    def clean(segments: Column) -> Column:
        return F.filter(F.transform(segments, drop_digits), lambda s: s != "")

    base = base_name(path)
    cut_ext = long_extension(path).isNotNull() & ~F.coalesce(extension_known, F.lit(False))
    kept = F.when(cut_ext, F.regexp_replace(base, r"\.[^.]*$", "")).otherwise(base)
    name = (F.when(F.contains(kept, F.lit(".")),
                   F.concat(drop_digits(F.regexp_extract(kept, r"^([^.]*)", 1)),
                            F.regexp_extract(kept, r"(?s)^[^.]*(\..*)$", 1)))
            .otherwise(drop_digits(kept)))
    folder = F.split(F.regexp_replace(path, r"/?[^/]*$", ""), "/")
    as_file = F.array_join(F.concat(clean(folder), F.array(name)), "/")
    return F.when(is_file_path(path), as_file).otherwise(F.array_join(clean(F.split(path, "/")), "/"))


def is_ip_address(name: Column) -> Column:
    """IPv4, IPv6, with or without port, or a text made almost only of digits, dots and colons."""
    s = trim_all(name)
    port = r"^(.*):\d+$"
    ip = (F.when(s.rlike(r"^\[.*\]:"), F.regexp_extract(s, r"^\[(.*?)\]:", 1))
          .when(s.rlike(port) & ~s.startswith("http"), F.regexp_extract(s, port, 1))
          .otherwise(s))
    octets = F.forall(F.split(ip, r"\."), lambda o: o.try_cast("int") <= 255)
    v4 = ip.rlike(r"^(\d{1,3}\.){3}\d{1,3}$") & octets
    v6 = F.contains(ip, F.lit("::")) | ip.rlike(r"^([0-9a-fA-F]{0,4}:){2,7}[0-9a-fA-F]{0,4}$")
    n = F.length(s)
    letters = n - F.length(F.regexp_replace(s, r"\p{L}", ""))
    marks = n - F.length(F.regexp_replace(s, r"[\d.:]", ""))
    mostly = s.rlike("[.:]") & (letters < 0.2 * n) & (marks > 0.7 * n)
    return F.coalesce((s != "") & (v4 | v6 | mostly), F.lit(False))


def host_neutral_name(name: Column) -> Column:
    """Bring a name to the form shared by all hosts and library versions."""
    out = F.lower(F.ltrim(slash_path(F.regexp_replace(name, r"_\d+$", "")), F.lit("/")))
    for pattern, repl in HOST_REWRITES:
        out = F.regexp_replace(out, pattern, repl)
    return (F.when(name.isin("", "-", "-_0"), name)
            .when(name.rlike(r"^[A-Za-z]+_\d+$"), F.lower(F.regexp_replace(name, r"_\d+$", "")))
            .when(name.startswith("connection_"), name)
            .otherwise(out))


def prefixes(c: Column, sep: str) -> Column:
    """All leading parts: 'a/b/c' → [a, a/b, a/b/c]."""
    parts = F.split(trim_all(c), "\\" + sep if sep == "." else sep)
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), sep))


def entity_class(c: Column) -> Column:
    s = trim_all(F.coalesce(c, F.lit("")))
    digits, dots, colons = s.rlike(r"\d"), F.contains(s, F.lit(".")), F.contains(s, F.lit(":"))
    return (F.when(s.rlike("[a-zA-Z]"), "website_filename")
            .when(digits & dots & colons, "ip_with_port")
            .when(digits & dots, "ip_no_port")
            .when(digits, "integer_only")
            .otherwise("unknown"))


def mask_values(c: Column) -> Column:
    """Replace UUIDs, 19-digit times and numbers with placeholders."""
    c = F.regexp_replace(c, r"[0-9A-F]{8}-[0-9A-F]{4}-[0-9A-F]{4}-[0-9A-F]{4}-[0-9A-F]{12}", "<UUID>")
    return F.regexp_replace(F.regexp_replace(c, r"\d{19}", "<TIMESTAMP>"), r"\d+", "<NUMBER>")


def parse_list(c: Column) -> Column:
    """List text such as "['a', 'b']" to an array of strings."""
    body = F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), r"^[\[\]]+|[\[\]]+$", ""), "['\"]", "")
    return F.filter(F.transform(F.split(body, ","), trim_all), lambda x: x != "")


def compound_type(values: Column) -> Column:
    low = F.array_sort(F.array_distinct(F.transform(values, F.lower)))
    return F.when(F.size(values) > 0, F.array_join(low, "+")).otherwise(F.lit("unknown"))


def telling_names(values: Column) -> Column:
    return F.filter(values, lambda v: ~v.isin(EMPTY_NAMES) & (F.length(v) > 1))


def longest_name(values: Column) -> Column:
    """Longest telling name, the first of equal length; '' when there is none."""
    return F.aggregate(telling_names(values), F.lit(""),
                       lambda best, v: F.when(F.length(v) > F.length(best), v).otherwise(best))


def _decimal_text(digits: Column) -> Column:
    """Decimal text of hex digits of any length, worked out in limbs of nine decimal digits, the least first."""
    base = F.lit(10 ** 9)

    def limb(state: Column, d: Column, by: Column) -> Column:
        t = d * by + state["carry"]
        return F.struct(F.array_append(state["limbs"], t % base).alias("limbs"), F.call_function("div", t, base).alias("carry"))

    def times(limbs: Column, piece: Column) -> Column:
        by = F.pow(F.lit(16), F.length(piece)).cast("bigint")
        start = F.struct(F.array().cast("array<bigint>").alias("limbs"), F.conv(piece, 16, 10).cast("bigint").alias("carry"))
        return F.aggregate(limbs, start, lambda state, d: limb(state, d, by), lambda state: F.when(
            state["carry"] > 0, F.array_append(state["limbs"], state["carry"])).otherwise(state["limbs"]))
    pieces = F.regexp_extract_all(digits, F.lit("[0-9a-fA-F]{1,7}"), F.lit(0))
    limbs = F.aggregate(pieces, F.array(F.lit(0).cast("bigint")), times)
    return F.array_join(F.transform(F.reverse(limbs), lambda d, i: F.when(i == 0, d.cast("string")).otherwise(F.lpad(d.cast("string"), 9, "0"))), "")


def hex_to_decimal(c: Column) -> Column:
    """Decimal text of 0x ids of any length; other values trimmed, otherwise unchanged."""
    s = trim_all(c)
    return (F.when(s.rlike("^0[xX][0-9a-fA-F]{1,16}$"), F.conv(F.substring(s, 3, 16), 16, 10))
            .when(s.rlike("^0[xX][0-9a-fA-F]+$"), _decimal_text(F.substring(s, 3, 1 << 30))).otherwise(s))


def property_hash(c: Column) -> Column:
    return F.sha2(c, 256)


def has_benign_keyword(text: Column, kind: str = "default") -> Column:
    words = F.array(*[F.lit(k) for k in BENIGN_KEYWORDS.get(kind, BENIGN_KEYWORDS["default"])])
    return F.exists(words, lambda k: F.contains(text, k))


def window_key_from_name(c: Column) -> Column:
    """'2018-11-02 22:00:00_2018-11-02 23:00:00' → '2018-11-02_22'."""
    return F.regexp_replace(F.regexp_extract(c, r"^(\d{4}-\d{2}-\d{2} \d{2})", 1), " ", "_")


def window_name_token(c: Column) -> Column:
    return F.translate(c, " :", "_-")


def seed_id(scenario: Column, log_type: Column, window: Column, idx: Column) -> Column:
    return F.concat_ws("_", scenario, log_type, window, idx.cast("string"))


def parse_seed_id(c: Column, log_types: Sequence[str] | None = ("audit", "dns", "firefox")) -> dict[str, Column]:
    """Scenario, log type, window name and log position of a seed id; empty (the position null) where it has another form.

    The log type is the first part that is in ``log_types``. None stands for any log type: then it is the part before the first
    one that begins with a date.
    """
    kind = r"([^_]+)_(\d{4}-\d{2}-\d{2}.*)" if log_types is None else "(" + "|".join(map(re.escape, log_types)) + ")_(.*)"
    form = rf"^(.*?)_{kind}_(\d+)$"
    return {
        "scenario": F.regexp_extract(c, form, 1),
        "log_type": F.regexp_extract(c, form, 2),
        "window_name": F.regexp_extract(c, form, 3),
        "log_pos": F.regexp_extract(c, form, 4).try_cast("bigint"),
    }
