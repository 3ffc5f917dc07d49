"""Column functions: parsing, normalising, hashing and text, all on the JVM side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Spellings of the tactics in the two views and their common names.
NETWORK_TACTICS = {
    "collection": "collection",
    "cleanup": "defence_evasion",
    "discovery": "discovery",
    "credential access": "credential_access",
    "command and control": "command_and_control",
    "persistence": "persistence",
    "exfiltration": "exfiltration",
    "lateral movement": "lateral_movement",
}
PROVENANCE_TACTICS = {
    "collection": "collection",
    "defenceEvasion": "defence_evasion",
    "discovery": "discovery",
    "credentialAccess": "credential_access",
    "CandC": "command_and_control",
    "persistence": "persistence",
    "exfiltration": "exfiltration",
    "lateralMovement": "lateral_movement",
    "initialAccess": "initial_access",
}
# Names of programs by what they are used for.
UTILITY_GROUPS = {
    "shell": ["sh", "dash", "bash", "zsh"],
    "interpreter": ["python", "python3", "python3.8", "perl", "ruby", "php"],
    "network": ["curl", "wget", "nc", "netcat", "ssh", "scp", "ftp", "telnet"],
    "archive_encoding": ["tar", "gzip", "zip", "base64", "openssl"],
    "privilege": ["sudo", "su", "chmod", "chown", "setcap"],
    "search": ["find", "grep", "locate"],
    "copy_move": ["cp", "mv", "rsync"],
    "package": ["apt", "apt-get", "apt-config", "dpkg", "snap"],
}
# Where system binaries, user binaries and files of three areas lie.
SYSTEM_BINARIES = ["/bin/", "/sbin/", "/usr/bin/", "/usr/sbin/", "/lib"]
USER_BINARIES = ["/home/", "/tmp/", "/var/tmp/"]
TMP_FILES, HOME_FILES = ["/tmp/", "/var/tmp/"], ["/home/"]
SYSTEM_FILES = ["/bin/", "/sbin/", "/usr/", "/lib", "/etc/"]


def finite(text: Column) -> Column:
    """The text as a finite double, else null."""
    x = F.trim(text).try_cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def first_timestamp(*texts: Column) -> Column:
    """the first of the texts that is a finite number of seconds."""
    return F.coalesce(*(finite(t) for t in texts))


def _integer(text: Column) -> Column:
    x = finite(text)
    return F.when(x == F.floor(x), x.cast("bigint"))


def normal_pid(text: Column) -> Column:
    """a number without its fraction, other text as it is, blank and null as ''."""
    t = F.trim(F.coalesce(text, F.lit("")))
    return F.coalesce(finite(t).cast("bigint").cast("string"), t)


def window_port(text: Column) -> Column:
    """a port from 0 to 65535 as text, anything else ''."""
    p = finite(text).cast("bigint")
    return F.when(p.between(0, 65535), p.cast("string")).otherwise("")


def graph_port(text: Column) -> Column:
    """0 and blank are '', whole numbers lose their fraction, other text stays."""
    t = F.trim(F.coalesce(text, F.lit("")))
    p = finite(t).cast("bigint")
    return F.when(p.isNull(), t).when(p == 0, "").otherwise(p.cast("string"))


def join_port(text: Column) -> Column:
    """a port from 1 to 65535, else null."""
    p = finite(text).cast("bigint")
    return F.when(p.between(1, 65535), p.cast("int"))


def usable_ip(text: Column) -> Column:
    """a written-out IPv4 address that is neither loopback nor unspecified, or an IPv6 one likewise."""
    t = F.trim(F.coalesce(text, F.lit("")))
    octet = "(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
    v4 = t.rlike(rf"^{octet}(\.{octet}){{3}}$") & ~t.startswith("127.") & (t != "0.0.0.0")
    groups = F.split(t, ":")
    hexes = F.forall(groups, lambda g: g.rlike("^[0-9A-Fa-f]{0,4}$"))
    shortened = F.size(F.split(t, "::", -1)) == 2
    v6 = t.contains(":") & hexes & ~t.contains(":::") & F.when(shortened, F.size(groups).between(3, 9)).otherwise((F.size(groups) == 8) & ~F.exists(groups, lambda g: g == ""))
    significant = F.regexp_replace(t, "[0:]", "")
    lone = shortened & t.startswith(":") | ~shortened
    return v4 | v6 & ~(lone & (significant == "")) & ~(lone & (significant == "1") & t.rlike("(^|:)0{0,3}1$"))


def truthy(text: Column) -> Column:
    """1, true and yes in any case."""
    return F.lower(F.trim(F.coalesce(text, F.lit("")))).isin("1", "true", "yes")


def canonical_tactic(raw: Column, names: dict[str, str]) -> Column:
    """F8: the common name of a spelling, ``unmapped:`` before unknown ones."""
    table = F.create_map(*(F.lit(x) for pair in names.items() for x in pair))
    return F.coalesce(F.try_element_at(table, raw), F.concat(F.lit("unmapped:"), raw))


def opaque_id(prefix: str, *parts: Column) -> Column:
    """prefix and the first 20 hex digits of the SHA-256 of the parts joined by bars."""
    return F.concat(F.lit(prefix + "_"), F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 20))


def stable_bucket(text: Column, modulus: int) -> Column:
    """the first 16 hex digits of the SHA-256, unsigned, modulo ``modulus``."""
    number = F.conv(F.substring(F.sha2(text, 256), 1, 16), 16, 10).cast("decimal(20,0)")
    return (number % F.lit(modulus).cast("decimal(20,0)")).cast("bigint")


def draw(*parts: Column) -> Column:
    """A number in [0, 1) that the parts alone decide, from the first 8 hex digits of their MD5."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 8), 16, 10).cast("bigint") / F.lit(4294967296.0)


def entity_kind(node_type: Column, subtype: Column) -> Column:
    """process, socket, file, directory, link or artifact."""
    s = F.lower(subtype)
    return F.when(node_type == "Process", "process").when(s == "network socket", "socket").when(s.isin("file", "directory", "link"), s).otherwise("artifact")


def operation_group(operation: Column) -> Column:
    """eight coarse groups of operations."""
    o = F.lower(F.trim(operation))
    return (
        F.when(o.isin("load", "execve", "connect", "unlink"), o)
        .when(o.startswith("rename"), "rename")
        .when(o.isin("setuid", "setgid", "chmod"), "privilege")
        .when(o.isin("open", "update"), "open_update")
        .otherwise("other")
    )


OPERATION_GROUPS = ("load", "execve", "connect", "unlink", "rename", "privilege", "open_update", "other")
RELATION_TYPES = ("Used", "WasGeneratedBy", "WasTriggeredBy", "WasDerivedFrom")


def starts_with_any(text: Column, heads: list[str]) -> Column:
    return F.coalesce(F.greatest(F.lit(False), *(text.startswith(h) for h in heads)), F.lit(False))


def basename(path: Column) -> Column:
    return F.lower(F.element_at(F.split(path, "/"), -1))


def path_depth(path: Column) -> Column:
    """Parts of a path below its root; a relative path has one fewer than it has names."""
    names = F.size(F.filter(F.split(path, "/"), lambda x: ~x.isin("", ".")))
    return F.when(F.coalesce(path, F.lit("")) == "", 0).otherwise(F.greatest(F.lit(0), names - F.when(path.startswith("/"), 0).otherwise(1)))


def path_features(exe: Column, name: Column) -> dict[str, Column]:
    """base name, depth, area flags and utility-group flags of a program."""
    base = F.when(F.coalesce(exe, F.lit("")) != "", basename(exe)).otherwise(F.lower(F.coalesce(name, F.lit(""))))
    out = {
        "base": base,
        "depth": path_depth(exe),
        "is_system_binary": starts_with_any(exe, SYSTEM_BINARIES).cast("int"),
        "is_user_binary": starts_with_any(exe, USER_BINARIES).cast("int"),
    }
    return out | {f"utility_{g}": base.isin(names).cast("int") for g, names in UTILITY_GROUPS.items()}


def normal_text(text: Column) -> Column:
    """decoded ``echo ... | base64`` payloads appended, lower case, masked addresses, technique ids and numbers."""
    payloads = F.regexp_extract_all(text, F.lit(r"(?i)echo\s+([A-Za-z0-9+/=]{8,})\s*\|\s*base64"), F.lit(1))
    decoded = F.transform(payloads, lambda p: F.make_valid_utf8(F.try_to_binary(p, F.lit("base64")).cast("string")))
    t = F.lower(F.concat_ws(" ", text, F.array_compact(decoded)))
    t = F.regexp_replace(t, r"\b(?:\d{1,3}\.){3}\d{1,3}\b", " <ip> ")
    t = F.regexp_replace(t, r"\bt\d{4}(?:\.\d{3})?\b", " <technique> ")
    t = F.regexp_replace(t, r"\b\d+\b", " <num> ")
    return F.trim(F.regexp_replace(t, r"\s+", " "))


def compact_text(text: Column, limit: int) -> Column:
    """white space squeezed, cut to ``limit`` characters with an ellipsis as the last."""
    t = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))
    return F.when(F.length(t) <= limit, t).otherwise(F.concat(F.rtrim(F.substring(t, 1, limit - 1)), F.lit("…")))


def configured_ip(command: Column) -> Column:
    """F16: the address that an ``ip addr add`` command configures, else null."""
    found = F.regexp_extract(command, r"ip\s+addr(?:ess)?\s+add\s+(\d{1,3}(?:\.\d{1,3}){3})", 1)
    return F.when(found != "", found)


def size_bin(count: Column) -> Column:
    """three bins of candidate counts."""
    return F.when(count <= 20, "<=20").when(count <= 100, "21-100").otherwise(">100")


def reason_code(processes: Column, temporal: Column, agrees: Column, margin: Column, least_margin: float = 0.2) -> Column:
    """why a case is not attributed, the first rule that holds."""
    return (
        F.when(processes == 0, "missing_process_evidence")
        .when(~temporal, "temporal_mismatch")
        .when(~agrees, "conflicting_cross_view_evidence")
        .when(margin < least_margin, "ambiguous_tactic")
        .otherwise("sufficient_observed_support")
    )
