"""Container files: Dockerfile instructions, compose services, and the rules on them."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.functions.text import literal_map
from siftline.sources.corpus import basename, lines

# Ports, names and passwords of the rules.
DATABASE_PORTS, CACHE_PORT = (5432, 3306, 27017), 6379
SECRET_NAME = r"(?i)password|passwd|secret|token|api_?key|private_?key|credential"
DEFAULT_PASSWORDS = ("postgres", "root", "password", "password123", "admin", "secret")
CAPABILITIES = ("ALL", "SYS_ADMIN", "NET_ADMIN", "SYS_PTRACE")
MOUNTS, HOST_MOUNT = r"/var/run/docker\.sock|/etc:|/root:|/proc:", r"^(?:\.:|\./[^:]+:|/[^:]+:)"
DUMMY = r"^(?:password|secret|admin)$|redispassword"
DATABASE_IMAGES, WEB_NAMES = r"(?i)postgres|mysql|mariadb|mongo|redis", r"(?i)web|app|api|frontend|backend|server"
DOCKER_SEVERITY = {
    "VG-DCK-001": "HIGH", "VG-DCK-002": "CRITICAL", "VG-DCK-003": "MEDIUM", "VG-DCK-004": "LOW", "VG-DCK-005": "MEDIUM", "VG-DCK-006": "HIGH", "VG-DCK-007": "HIGH",
    "VG-DCK-008": "HIGH", "VG-DCK-009": "MEDIUM", "VG-DCK-010": "HIGH", "VG-DCK-011": "HIGH", "VG-DCK-012": "HIGH", "VG-DCK-013": "CRITICAL", "VG-DCK-014": "HIGH", "VG-DCK-015": "HIGH", "VG-DCK-016": "HIGH", "VG-DCK-017": "HIGH",
    "VG-DCK-018": "HIGH", "VG-DCK-019": "HIGH", "VG-DCK-020": "HIGH",
}


def dockerfiles(files: DataFrame) -> DataFrame:
    return files.where(F.lower(basename(F.col("rel_path"))).rlike(r"^dockerfile(?:\..+)?$|\.dockerfile$"))


def instructions(files: DataFrame) -> DataFrame:
    """(project, rel_path, line_no, op, key, value, raw) of each FROM, COPY, ADD, ENV, ARG, USER, EXPOSE and HEALTHCHECK of the Dockerfiles."""
    x = lines(dockerfiles(files), ["project", "rel_path"]).withColumn("raw", F.trim("line"))
    op = F.upper(F.regexp_extract("raw", r"(?i)^(FROM|COPY|ADD|ENV|ARG|USER|EXPOSE|HEALTHCHECK)(?:\s|$)", 1))
    rest = F.trim(F.regexp_replace("raw", r"^\S+\s*", ""))
    x = x.where(op != "").select("project", "rel_path", "line_no", op.alias("op"), rest.alias("rest"), "raw")
    named = F.regexp_extract("rest", r"^([A-Za-z_]\w*)", 1)
    assigned = F.regexp_replace(F.regexp_replace("rest", r"^[A-Za-z_]\w*(?:\s*=\s*|\s+|$)", ""), r"""^(["'])(.*)\1$""", "$2")
    image = F.split_part("rest", F.lit(" "), F.lit(1))
    tag = F.when(image.contains("@"), F.regexp_extract(image, "@(.*)$", 1)).otherwise(F.regexp_extract(image, r":([^:/]+)$", 1))
    key = F.when(F.col("op").isin("ENV", "ARG"), named).when(F.col("op") == "FROM", F.regexp_replace(image, r"(?:@.*|:[^:/]+)$", "")).when(F.col("op").isin("COPY", "ADD"), F.split_part(F.regexp_replace("rest", r"^(?:--\S+\s+)*", ""), F.lit(" "), F.lit(1))).otherwise(image)
    value = F.when(F.col("op").isin("ENV", "ARG"), assigned).when(F.col("op") == "FROM", tag).when(F.col("op").isin("COPY", "ADD"), F.element_at(F.split("rest", r"\s+"), -1)).otherwise("")
    return x.select("project", "rel_path", "line_no", "op", key.alias("key"), value.alias("value"), "raw")


def dockerfile_hits(files: DataFrame) -> DataFrame:
    """(project, rel_path, line_no, rule_id, severity): what single instructions, or their absence, break.

    The last USER counts; no USER and no HEALTHCHECK are found with one aggregate over the files, so that a
    Dockerfile without any instruction counts too.
    """
    ins = instructions(files)
    op, key, value = F.col("op"), F.col("key"), F.col("value")
    port = F.regexp_extract(key, r"^([0-9]+)", 1).try_cast("int")
    rules = {
        "VG-DCK-002": (op == "ENV") & key.rlike(SECRET_NAME) & (value != "") & ~value.startswith("$"),
        "VG-DCK-003": op.isin("COPY") & key.isin(".", "./") & value.isin(".", "./", "/app", "/app/"),
        "VG-DCK-005": (op == "FROM") & value.isin("", "latest") & (F.lower(key) != "scratch"),
        "VG-DCK-006": (op == "EXPOSE") & port.isin(*DATABASE_PORTS),
        "VG-DCK-007": (op == "EXPOSE") & (port == CACHE_PORT),
        "VG-DCK-017": (op == "ARG") & key.rlike(SECRET_NAME),
    }
    single = ins.select("project", "rel_path", "line_no", F.explode(F.array_compact(F.array(*(F.when(c, F.lit(r)) for r, c in rules.items())))).alias("rule_id"))
    ends = ins.groupBy("project", "rel_path").agg(F.max_by(F.when(op == "USER", key), F.when(op == "USER", F.col("line_no"))).alias("user"), F.max(F.when(op == "USER", F.col("line_no"))).alias("at"), F.max(op == "HEALTHCHECK").alias("checked"))
    whole = dockerfiles(files).select("project", "rel_path").join(ends, ["project", "rel_path"], "left")
    absent = F.array_compact(F.array(
        F.when(F.col("user").isNull() | F.col("user").isin("root", "0"), F.struct(F.lit("VG-DCK-001").alias("rule_id"), F.coalesce("at", F.lit(1)).alias("line_no"))),
        F.when(~F.coalesce("checked", F.lit(False)), F.struct(F.lit("VG-DCK-004").alias("rule_id"), F.lit(1).alias("line_no"))),
    ))
    missing = whole.select("project", "rel_path", F.explode(absent).alias("h")).select("project", "rel_path", "h.line_no", "h.rule_id")
    severity = literal_map(DOCKER_SEVERITY)
    return single.unionByName(missing).withColumn("severity", F.element_at(severity, F.col("rule_id")))


_SERVICE = "project string, rel_path string, service string, line_no int, image string, user string, privileged boolean, network_mode string, pid string, ipc string, ports array<string>, volumes array<string>, cap_add array<string>, env array<string>"


def compose_services(text: str) -> list[dict]:
    """The services of a compose file with their ports, volumes, capabilities and environment; by indentation alone."""
    out: list[dict] = []
    inside, base, item, block = False, 0, 0, ""
    for no, line in enumerate(text.split("\n"), 1):
        s = line.strip()
        if not s or s.startswith("#"):
            continue
        depth = len(line) - len(line.lstrip())
        if depth == 0:
            inside = s.startswith("services:")
            base = 0
            continue
        if not inside:
            continue
        m = re.match(r"[\"']?([\w.-]+)[\"']?:\s*(.*)$", s)
        if base == 0:
            base = depth
        if depth == base and m and not m[2]:
            out.append({"service": m[1], "line_no": no, "ports": [], "volumes": [], "cap_add": [], "env": []})
            item, block = 0, ""
        elif out:
            x = out[-1]
            item = item or depth
            if depth == item and m:
                block = m[1] if not m[2] else ""
                v = m[2].strip("\"'")
                if m[1] in ("image", "user", "network_mode", "pid", "ipc"):
                    x[m[1]] = v
                elif m[1] == "privileged":
                    x["privileged"] = v.lower() == "true"
                elif m[2].startswith("[") and m[1] in ("ports", "volumes", "cap_add"):
                    x[m[1]] += [p.strip().strip("\"'") for p in m[2].strip("[]").split(",") if p.strip()]
            elif block in ("ports", "volumes", "cap_add") and s.startswith("- "):
                x[block].append(s[2:].strip().strip("\"'"))
            elif block == "environment":
                k, _, v = s[2:].partition("=") if s.startswith("- ") else s.partition(":")
                x["env"].append(k.strip() + "=" + v.strip().strip("\"'"))
    return out


def services(files: DataFrame) -> DataFrame:
    """One row for each service of the compose files."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split(" ")[0] for c in _SERVICE.split(", ")]
        for b in batches:
            found = [{"project": p, "rel_path": r, "privileged": False} | x for p, r, t in zip(b["project"], b["rel_path"], b["content"], strict=True) for x in compose_services(t)]
            yield pd.DataFrame({n: pd.Series([x.get(n) for x in found], dtype=object) for n in names})

    f = files.where(F.lower(basename(F.col("rel_path"))).rlike(r"compose.*\.ya?ml$") & F.col("content").isNotNull())
    return f.select("project", "rel_path", "content").mapInPandas(run, _SERVICE)


def compose_hits(svc: DataFrame) -> DataFrame:
    """(project, rel_path, line_no, service, rule_id, severity): what services break alone and with the others of their file."""
    sensitive = F.exists("volumes", lambda v: v.rlike(MOUNTS))
    mounted = F.exists("volumes", lambda v: v.rlike(HOST_MOUNT))
    maps = lambda *ports: F.exists("ports", lambda p: F.regexp_replace(p, "/.*$", "").isin(*(f"{n}:{n}" for n in ports)))
    weak = F.exists("env", lambda e: e.rlike(r"(?i)^(?:\w*PASS(?:WORD)?|SECRET|KEY)\s*=\s*\S") & (F.lower(F.substring_index(e, "=", -1)).rlike(DUMMY) | (F.length(F.substring_index(e, "=", -1)) < 8)))
    rules = {
        "VG-DCK-006": maps(*DATABASE_PORTS),
        "VG-DCK-007": maps(CACHE_PORT),
        "VG-DCK-008": F.lower("user").isin("root", "0"),
        "VG-DCK-009": mounted & ~sensitive,
        "VG-DCK-010": weak,
        "VG-DCK-011": F.col("privileged"),
        "VG-DCK-012": F.exists("cap_add", lambda c: F.upper(c).isin(*CAPABILITIES)),
        "VG-DCK-013": sensitive,
        "VG-DCK-015": F.col("network_mode") == "host",
        "VG-DCK-016": (F.col("pid") == "host") | (F.col("ipc") == "host"),
        "VG-DCK-019": F.coalesce(F.lower("user"), F.lit("root")).isin("root", "0") & F.exists("volumes", lambda v: F.split_part(v, F.lit(":"), F.lit(1)).rlike(r"^(?:\.$|\./|/)")),
    }
    keys = ["project", "rel_path"]
    alone = svc.select(*keys, "line_no", "service", F.explode(F.array_compact(F.array(*(F.when(c, F.lit(r)) for r, c in rules.items())))).alias("rule_id"))
    database = svc.where(F.coalesce("image", "service").rlike(DATABASE_IMAGES) & (F.size("ports") > 0))
    web = svc.where(F.col("service").rlike(WEB_NAMES)).select(*keys).distinct()
    beside = database.join(web, keys, "left_semi").select(*keys, "line_no", "service", F.lit("VG-DCK-018").alias("rule_id"))
    env = svc.select(*keys, "line_no", "service", F.explode("env").alias("e"))
    env = env.select(*keys, "line_no", "service", F.regexp_extract("e", "^([^=]*)=", 1).alias("k"), F.regexp_extract("e", "^[^=]*=(.*)$", 1).alias("v")).where("v <> ''")
    weak = env.where(F.col("k").rlike("(?i)pass") & F.lower("v").isin(*DEFAULT_PASSWORDS)).select(*keys, "line_no", "service", F.lower("v").alias("secret")).distinct()
    other = env.select(*keys, F.col("service").alias("user_of"), F.lower("v").alias("used"))
    shared = weak.join(other, keys).where((F.col("user_of") != F.col("service")) & F.contains("used", "secret")).select(*keys, "line_no", "service", F.lit("VG-DCK-020").alias("rule_id")).distinct()
    severity = literal_map(DOCKER_SEVERITY)
    return alone.unionByName(beside).unionByName(shared).withColumn("severity", F.element_at(severity, F.col("rule_id")))


def exposed_context(files: DataFrame) -> DataFrame:
    """(project, rel_path, line_no): the first broad COPY of each Dockerfile in a project that holds a sensitive file and has no .dockerignore."""
    from siftline.operators.lexical import sensitive_names

    copies = instructions(files).where(F.col("op").isin("COPY", "ADD") & F.col("key").isin(".", "./")).groupBy("project", "rel_path").agg(F.min("line_no").alias("line_no"))
    sensitive = sensitive_names(files, ["project"]).select("project").distinct()
    ignored = files.where(basename(F.col("rel_path")) == ".dockerignore").select("project").distinct()
    return copies.join(sensitive, "project", "left_semi").join(ignored, "project", "left_anti").select("project", "rel_path", "line_no")
