"""Entity graph: typed nodes and time-stamped edges as two tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from nightjar.functions.net import is_private_ip
from nightjar.functions.text import base_name
from nightjar.operators.intel import match_observables
from nightjar.schema import filled
from nightjar.session import materialize

IOC_RISK = 90.0  # fixed value
# File event -> relation.
FILE_RELATION = {"file_create": "wrote", "file_modify": "modified", "file_delete": "deleted", "file_read": "read"}


def node_id(kind: str, value: Column) -> Column:
    """``kind:VALUE`` for hosts, ``kind:value`` otherwise."""
    return F.concat(F.lit(kind + ":"), F.upper(value) if kind == "host" else F.lower(value))


def _scoped(kind: str, value: Column) -> Column:
    """Processes and services live on a host."""
    return node_id(kind, F.concat(F.coalesce(F.when(filled(F.col("host")), F.col("host")), F.lit("?")), F.lit("/"), value))


def derive_edges(events: DataFrame) -> DataFrame:
    """Relations stated by each event, in one pass: ``(src, dst, relation, ...)`` plus the event's id and time."""
    c = F.col
    kind, action = c("event_type"), c("action")
    has = {n: filled(c(n)) for n in ("host", "user", "src_ip", "dst_ip", "process_name", "parent_process_name", "file_path", "domain", "target_user", "service_name")}
    host, user = node_id("host", c("host")), node_id("user", c("user"))
    src_ip, dst_ip, domain = node_id("ip", c("src_ip")), node_id("ip", c("dst_ip")), node_id("domain", c("domain"))
    process, parent = _scoped("process", c("process_name")), _scoped("process", c("parent_process_name"))
    file, target = node_id("file", c("file_path")), node_id("user", c("target_user"))
    accessed = base_name(c("file_path"))
    service = _scoped("service", F.coalesce(F.when(has["service_name"], c("service_name")), c("file_path")))
    auth, access = kind == "authentication", (kind == "process_access") & has["process_name"]
    proc = kind.isin("process_start", "process_end") & has["process_name"]
    files = kind.isin(list(FILE_RELATION)) & has["file_path"]
    conn, dns = (kind == "network_connection") & has["dst_ip"], (kind == "dns_query") & has["domain"]
    priv = kind.isin("privilege_change", "group_change")
    account = kind.isin("user_created", "user_deleted") & has["target_user"]
    svc = kind.isin("service_started", "service_stopped", "scheduled_task") & (has["service_name"] | has["file_path"])
    file_rel = F.element_at(F.create_map(*[F.lit(v) for pair in FILE_RELATION.items() for v in pair]), kind)
    acting = F.when(has["process_name"], process).when(has["host"], host)

    def edge(condition: Column, src: Column, dst: Column, relation: Column | str, **attrs: Column) -> Column:
        rel = F.lit(relation) if isinstance(relation, str) else relation
        pairs = [p for k, v in attrs.items() for p in (F.lit(k), v.cast("string"))]
        extra = F.map_filter(F.create_map(*pairs), lambda _, v: v.isNotNull()) if pairs else F.create_map().cast("map<string,string>")
        return F.when(condition, F.struct(src.alias("src"), dst.alias("dst"), rel.alias("relation"), extra.alias("attributes")))

    private_src = has["src_ip"] & is_private_ip(c("src_ip"))
    edges = F.array_compact(F.array(
        edge(has["host"] & private_src & ~auth, host, src_ip, "has_ip"),
        edge(auth & has["user"] & has["host"], user, host, F.when(action == "login_success", "logged_into").otherwise("failed_login"), src_ip=c("src_ip"), country=c("geo_country")),
        edge(auth & has["src_ip"] & has["user"], src_ip, user, "authenticated_as", outcome=action),
        edge(auth & has["user"] & has["host"] & private_src, host, src_ip, "has_ip"),
        edge(auth & has["dst_ip"] & has["host"] & (action == "login_success"), host, dst_ip, "authenticated_to", privilege=c("privilege")),
        edge(proc & has["parent_process_name"], parent, process, "spawned", command_line=c("command_line")),
        edge(proc & ~has["parent_process_name"] & has["host"], host, process, "executed", command_line=c("command_line")),
        edge(proc & has["user"] & (kind == "process_start"), user, process, "ran"),
        edge(access & accessed.isNotNull(), process, _scoped("process", accessed), "accessed"),
        edge(access & accessed.isNull() & has["host"], host, process, "executed"),
        edge(files & acting.isNotNull(), acting, file, file_rel),
        edge(conn & acting.isNotNull(), acting, dst_ip, "connected_to", port=c("dst_port"), bytes_out=c("bytes_out"), protocol=c("protocol")),
        edge(conn & has["domain"], domain, dst_ip, "resolves_to"),
        edge(dns & has["host"], host, domain, "resolved", outcome=c("outcome")),
        edge(dns & has["dst_ip"], domain, dst_ip, "resolves_to"),
        edge(priv & has["user"] & has["host"], user, host, "escalated_on", privilege=c("privilege")),
        edge(priv & has["target_user"] & has["user"], user, target, "granted_privilege", privilege=c("privilege")),
        edge(account & has["user"], user, target, F.when(kind == "user_created", "created_account").otherwise("deleted_account")),
        edge(account & has["host"], target, host, "exists_on"),
        edge(svc & has["host"], host, service, F.when(filled(action), action).otherwise(kind), command_line=c("command_line")),
        edge(svc & has["user"], user, service, F.when(action.isin("installed", "created"), "installed").otherwise("touched")),
    ))
    return events.select("tenant_id", "event_id", "timestamp", "seq", F.inline(edges))


def cap_edges(edges: DataFrame, limit: int | None = None) -> DataFrame:
    """First ``limit`` edges per (source, target, relation), all without a limit; the rank limit runs before the shuffle."""
    if limit is None:
        return edges
    w = Window.partitionBy("tenant_id", "src", "dst", "relation").orderBy("timestamp", "seq")
    return edges.withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= limit).drop("nth")


def _mentions(events: DataFrame) -> DataFrame:
    """Every node mention of an event, whether or not an edge follows from it."""
    c = F.col
    kind = c("event_type")
    auth = kind == "authentication"
    proc, access = kind.isin("process_start", "process_end"), kind == "process_access"
    files, net, dns = kind.isin(list(FILE_RELATION)), kind == "network_connection", kind == "dns_query"
    svc = kind.isin("service_started", "service_stopped", "scheduled_task")
    priv = kind.isin("privilege_change", "group_change")
    account = kind.isin("user_created", "user_deleted")
    has = {n: filled(c(n)) for n in ("host", "user", "src_ip", "dst_ip", "process_name", "parent_process_name", "file_path", "domain", "target_user", "service_name")}
    accessed = base_name(c("file_path"))
    service = F.coalesce(F.when(has["service_name"], c("service_name")), c("file_path"))

    def mention(condition: Column, of_kind: str, node: Column, label: Column, **attrs: Column) -> Column:
        known = {"name": None, "country": None, "hash": None, "size": None} | attrs
        return F.when(condition, F.struct(F.lit(of_kind).alias("kind"), node.alias("node"), label.alias("label"),
                                          *[(v.cast("string") if v is not None else F.lit(None).cast("string")).alias(k) for k, v in known.items()]))

    def scoped(of_kind: str, condition: Column, value: Column, **attrs: Column) -> Column:
        label = F.concat(F.coalesce(F.when(has["host"], c("host")), F.lit("?")), F.lit("/"), value)
        return mention(condition, of_kind, _scoped(of_kind, value), label, **attrs)

    items = F.array_compact(F.array(
        mention(has["host"], "host", node_id("host", c("host")), c("host")),
        mention(has["user"], "user", node_id("user", c("user")), c("user")),
        mention(has["host"] & has["src_ip"] & is_private_ip(c("src_ip")) & ~auth, "ip", node_id("ip", c("src_ip")), c("src_ip")),
        mention(auth & has["src_ip"] & has["user"], "ip", node_id("ip", c("src_ip")), c("src_ip"), country=c("geo_country")),
        mention((auth & has["dst_ip"] & has["host"] & (c("action") == "login_success")) | (net & has["dst_ip"]) | (dns & has["domain"] & has["dst_ip"]), "ip", node_id("ip", c("dst_ip")), c("dst_ip")),
        scoped("process", (proc | access) & has["process_name"], c("process_name"), name=c("process_name")),
        scoped("process", ((files & has["file_path"]) | (net & has["dst_ip"])) & has["process_name"], c("process_name"), name=c("process_name")),
        scoped("process", proc & has["process_name"] & has["parent_process_name"], c("parent_process_name"), name=c("parent_process_name")),
        scoped("process", access & has["process_name"] & accessed.isNotNull(), accessed, name=accessed),
        mention(files & has["file_path"], "file", node_id("file", c("file_path")), c("file_path"), hash=c("file_hash"), size=c("file_size")),
        mention((net & has["dst_ip"] & has["domain"]) | (dns & has["domain"]), "domain", node_id("domain", c("domain")), c("domain")),
        mention((priv | account) & has["target_user"], "user", node_id("user", c("target_user")), c("target_user")),
        scoped("service", svc & (has["service_name"] | has["file_path"]), service),
    ))
    return events.select("tenant_id", "timestamp", "seq", F.posexplode(items).alias("pos", "m")).select("tenant_id", "timestamp", "seq", "pos", "m.*")


def derive_nodes(events: DataFrame) -> DataFrame:
    """Nodes with first label, first and last time, mention count and the last non-null attributes."""
    at = F.struct("timestamp", "seq", "pos")

    def last(name: str) -> Column:
        return F.max_by(name, F.when(F.col(name).isNotNull(), at)).alias(name)

    return _mentions(events).groupBy("tenant_id", "node", "kind").agg(
        F.min_by("label", at).alias("label"), F.min("timestamp").alias("first_seen"), F.max("timestamp").alias("last_seen"),
        F.count(F.lit(1)).alias("mentions"), last("name"), last("country"), last("hash"), last("size"))


def ioc_links(nodes: DataFrame, iocs: DataFrame) -> DataFrame:
    """``known_as`` edges from listed addresses, domains and hashed files to indicator nodes."""
    value = F.when(F.col("kind") == "file", F.col("hash")).otherwise(F.col("label"))
    observed = nodes.where(F.col("kind").isin("ip", "domain", "file")).select(
        "tenant_id", "node", F.when(F.col("kind") == "file", "hash").otherwise(F.col("kind")).alias("kind"), value.alias("observed")).where(filled(F.col("observed")))
    hits = match_observables(observed, iocs, ["tenant_id", "node"])
    return hits.select("tenant_id", F.col("node").alias("src"), node_id("ioc", F.col("ioc.value")).alias("dst"), F.lit("known_as").alias("relation"),
                       F.col("ioc.threat").alias("threat"), F.col("ioc.source").alias("source"), F.col("ioc.confidence").alias("confidence"), F.lit(IOC_RISK).alias("risk"))


def _undirected(edges: DataFrame) -> DataFrame:
    pairs = edges.select("tenant_id", "src", "dst")
    return pairs.unionByName(pairs.select("tenant_id", F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()


def neighborhood(edges: DataFrame, seeds: DataFrame, depth: int = 1) -> tuple[DataFrame, DataFrame]:
    """Nodes within ``depth`` undirected steps of the seeds ``(tenant_id, node)`` with their distance, and the
    edges among them."""
    both = _undirected(edges)
    ball = seeds.select("tenant_id", "node").distinct().withColumn("hops", F.lit(0))
    for step in range(1, depth + 1):
        frontier = ball.where(F.col("hops") == step - 1).select("tenant_id", F.col("node").alias("src"))
        reached = both.join(frontier, ["tenant_id", "src"]).select("tenant_id", F.col("dst").alias("node")).distinct()
        fresh = reached.join(ball.select("tenant_id", "node"), ["tenant_id", "node"], "left_anti").withColumn("hops", F.lit(step))
        ball = materialize(ball.unionByName(fresh))
    inside = ball.select("tenant_id", "node")
    induced = edges.join(inside.withColumnRenamed("node", "src"), ["tenant_id", "src"], "left_semi").join(inside.withColumnRenamed("node", "dst"), ["tenant_id", "dst"], "left_semi")
    return ball, induced


def entity_profile(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes with in and out degree (parallel edges count)."""
    ends = edges.select("tenant_id", F.inline(F.array(
        F.struct(F.col("src").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("dst").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i")))))
    degree = ends.groupBy("tenant_id", "node").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"))
    return nodes.join(degree, ["tenant_id", "node"], "left").fillna(0, ["in_degree", "out_degree"])


def find_entities(nodes: DataFrame, query: str, limit: int = 25) -> DataFrame:
    """Case-insensitive search on id or label, earliest known first."""
    q = query.lower()
    found = nodes.where(F.lower("node").contains(q) | F.lower("label").contains(q))
    return found.orderBy("first_seen", "node").limit(limit)


def paths_between(edges: DataFrame, src: str, dst: str, cutoff: int = 6, limit: int = 10) -> DataFrame:
    """Simple directed paths, shortest first.

    Walks run only over edges that can still reach the target in the remaining steps (distances to the target
    are found backwards first), so dead ends are never extended.
    """
    simple = materialize(edges.select("tenant_id", "src", "dst").where(F.col("src") != F.col("dst")).distinct())
    togo = simple.where(F.col("dst") == dst).select("tenant_id", F.col("dst").alias("node")).distinct().withColumn("left", F.lit(0))
    for step in range(1, cutoff + 1):
        back = simple.join(togo.where(F.col("left") == step - 1).select("tenant_id", F.col("node").alias("dst")), ["tenant_id", "dst"]) \
            .select("tenant_id", F.col("src").alias("node")).distinct()
        togo = materialize(togo.unionByName(back.join(togo, ["tenant_id", "node"], "left_anti").withColumn("left", F.lit(step))))
    useful = simple.join(togo.select("tenant_id", F.col("node").alias("dst"), "left"), ["tenant_id", "dst"])
    walks = simple.where(F.col("src") == src).select("tenant_id").distinct().withColumn("at", F.lit(src)).withColumn("path", F.array(F.lit(src)))
    done = None
    for step in range(1, cutoff + 1):
        walks = (
            walks.join(useful, (walks["at"] == useful["src"]) & (walks["tenant_id"] == useful["tenant_id"]) & (useful["left"] <= cutoff - step))
            .where(~F.array_contains("path", F.col("dst")))
            .select(walks["tenant_id"], F.col("dst").alias("at"), F.array_append("path", F.col("dst")).alias("path"))
        )
        walks = materialize(walks)
        arrived = walks.where(F.col("at") == dst).select("tenant_id", "path")
        done = arrived if done is None else done.unionByName(arrived)
        walks = walks.where(F.col("at") != dst)
        if done.limit(limit).count() >= limit:
            break
    return done.withColumn("hops", F.size("path") - 1).orderBy("hops", "tenant_id", F.array_join("path", ">")).limit(limit)


def hosts_by_user(edges: DataFrame) -> DataFrame:
    pairs = edges.where(F.col("src").startswith("user:") & F.col("dst").startswith("host:")).select(
        "tenant_id", F.col("src").alias("user"), F.substring_index("dst", ":", -1).alias("host")).distinct()
    return pairs.groupBy("tenant_id", "user").agg(F.array_sort(F.collect_list("host")).alias("hosts"))


def _via_process(edges: DataFrame, relation: str | None) -> DataFrame:
    """(host, ip) pairs where a process the host points to connected to the address."""
    first = edges.where(F.col("src").startswith("host:"))
    if relation:
        first = first.where(F.col("dst").startswith("process:"))
    hop1 = first.select("tenant_id", F.col("src").alias("host"), F.col("dst").alias("middle")).distinct()
    hop2 = edges.where((F.col("relation") == "connected_to") & F.col("dst").startswith("ip:")).select("tenant_id", F.col("src").alias("middle"), F.col("dst").alias("ip")).distinct()
    return hop1.join(hop2, ["tenant_id", "middle"]).select("tenant_id", "host", "ip")


def _plain(pairs: DataFrame) -> DataFrame:
    return pairs.select("tenant_id", F.expr("substring(host, 6)").alias("host"), F.expr("substring(ip, 4)").alias("ip")).distinct()


def ips_by_host(edges: DataFrame) -> DataFrame:
    """Addresses a host points to directly, or that anything it points to connected to."""
    direct = edges.where(F.col("src").startswith("host:") & F.col("dst").startswith("ip:")).select("tenant_id", F.col("src").alias("host"), F.col("dst").alias("ip"))
    return _plain(direct.unionByName(_via_process(edges, None)))


def contacted_ips(edges: DataFrame, spawned: bool = False) -> DataFrame:
    """(host, ip) the host connected to, itself or through a process it executed directly.

    ``spawned`` also counts processes started by other processes of the host.
    """
    direct = edges.where(F.col("src").startswith("host:") & F.col("dst").startswith("ip:") & (F.col("relation") == "connected_to")).select("tenant_id", F.col("src").alias("host"), F.col("dst").alias("ip"))
    pairs = direct.unionByName(_via_process(edges, "process"))
    if spawned:
        inner = edges.where((F.col("relation") == "connected_to") & F.col("src").startswith("process:") & F.col("dst").startswith("ip:"))
        owner = F.concat(F.lit("host:"), F.upper(F.substring_index(F.expr("substring(src, 9)"), "/", 1)))
        pairs = pairs.unionByName(inner.select("tenant_id", owner.alias("host"), F.col("dst").alias("ip")))
    return _plain(pairs)


def lateral_neighbors(host_ips: DataFrame, internal_only: bool = False) -> DataFrame:
    """Ordered pairs of hosts that contacted a common address (the pairs are the result asked for).

    Addresses contacted by the same set of hosts give the same pairs, so one of each set is joined.
    """
    pairs = host_ips.where(is_private_ip(F.col("ip"))) if internal_only else host_ips
    sets = pairs.groupBy("tenant_id", "ip").agg(F.count(F.lit(1)).alias("hosts"), F.bit_xor(F.xxhash64("host")).alias("x"), F.sum(F.xxhash64("host").cast("decimal(38,0)")).alias("s"))
    chosen = sets.where(F.col("hosts") > 1).groupBy("tenant_id", "hosts", "x", "s").agg(F.min("ip").alias("ip")).select("tenant_id", "ip")
    left = pairs.join(chosen, ["tenant_id", "ip"], "left_semi")
    right = left.select("tenant_id", "ip", F.col("host").alias("neighbor"))
    return left.join(right, ["tenant_id", "ip"]).where(F.col("host") != F.col("neighbor")).select("tenant_id", "host", "neighbor").distinct()


def graph_stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes by kind plus totals."""
    kinds = nodes.groupBy(F.col("kind").alias("name")).agg(F.count(F.lit(1)).alias("n"))
    totals = nodes.agg(F.count(F.lit(1)).alias("n")).select(F.lit("nodes").alias("name"), "n").unionByName(edges.agg(F.count(F.lit(1)).alias("n")).select(F.lit("edges").alias("name"), "n"))
    return kinds.unionByName(totals)


def node_risk(nodes: DataFrame, incidents: DataFrame) -> DataFrame:
    """Highest risk of the incidents that touch a user or host node."""
    touched = incidents.select("tenant_id", "risk_score", F.explode(F.concat(
        F.transform("affected_users", lambda u: node_id("user", u)), F.transform("affected_hosts", lambda h: node_id("host", h)))).alias("node"))
    best = touched.groupBy("tenant_id", "node").agg(F.max("risk_score").alias("risk"))
    return nodes.join(best, ["tenant_id", "node"], "left").withColumn("risk", F.coalesce("risk", F.lit(0.0)))
