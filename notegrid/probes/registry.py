"""Registry of runnable queries and their SQL twins."""

from __future__ import annotations

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def probe(name: str, sql: str | None = None):
    """Register ``fn(tables) -> DataFrame`` under ``name``."""
    def register(fn):
        if name in QUERIES:
            raise ValueError(f"query registered twice: {name}")

        def run(spark, folder):
            from notegrid.sources.tables import Tables
            return fn(Tables(spark, folder))

        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return register


# Table expressions shared by the SQL twins: the notes each table stands for.
CTE = {
    "region_n": "SELECT 'Places/'||r_name AS path, r_name AS name, 'Places' AS folder, 'region' AS type,"
                " r_regionkey AS k FROM region",
    "nation_n": "SELECT 'Places/'||n_name AS path, n_name AS name, 'Places' AS folder, 'nation' AS type,"
                " n_nationkey AS k, '[['||r_name||']]' AS parent, 'Places/'||r_name AS parent_path"
                " FROM nation JOIN region ON n_regionkey=r_regionkey",
    "customer_n": "SELECT 'Parties/'||c_mktsegment||'/'||replace(c_name,'#',' ') AS path,"
                  " replace(c_name,'#',' ') AS name, 'Parties/'||c_mktsegment AS folder,"
                  " 'customer' AS type, c_custkey AS k, c_acctbal AS balance, c_mktsegment AS segment,"
                  " '[['||n_name||']]' AS parent, 'Places/'||n_name AS parent_path, n_nationkey"
                  " FROM customer JOIN nation ON c_nationkey=n_nationkey",
    "supplier_n": "SELECT 'Parties/Suppliers/'||replace(s_name,'#',' ') AS path,"
                  " replace(s_name,'#',' ') AS name, 'Parties/Suppliers' AS folder,"
                  " 'supplier' AS type, s_suppkey AS k, s_acctbal AS balance,"
                  " '[['||n_name||']]' AS parent, 'Places/'||n_name AS parent_path"
                  " FROM supplier JOIN nation ON s_nationkey=n_nationkey",
    "order_n": "SELECT 'Orders/'||strftime(o_orderdate,'%Y-%m')||'/Order '||o_orderkey AS path,"
               " 'Order '||o_orderkey AS name, 'Orders/'||strftime(o_orderdate,'%Y-%m') AS folder,"
               " 'order' AS type, o_orderkey AS k, o_orderstatus AS status,"
               " strftime(o_orderdate,'%Y-%m-%d') AS ordered, o_totalprice AS total,"
               " o_orderpriority AS priority, o_custkey,"
               " '[[Customer '||lpad(o_custkey::VARCHAR,9,'0')||']]' AS parent FROM orders",
    "part_n": "SELECT 'Parts/'||p_brand||'/Part '||p_partkey AS path, 'Part '||p_partkey AS name,"
              " 'Parts/'||p_brand AS folder, 'part' AS type, p_partkey AS k, p_type AS kind,"
              " p_size AS size, p_retailprice AS price, p_name AS alias FROM part",
    "document_n": "SELECT 'Docs/'||source||'/Doc '||d.doc_id AS path, 'Doc '||d.doc_id AS name,"
                  " 'Docs/'||source AS folder, 'document' AS type, d.doc_id AS k, lang,"
                  " n_chars AS chars, quality, toxic, text AS body"
                  " FROM documents d LEFT JOIN labels l ON d.doc_id=l.doc_id",
    "turn_n": "SELECT 'Chats/'||conv_id||'/Turn '||conv_id||'-'||turn AS path,"
              " 'Turn '||conv_id||'-'||turn AS name, 'Chats/'||conv_id AS folder, 'turn' AS type,"
              " turn AS k, role, text AS body, conv_id FROM conversations",
}
CTE["index_n"] = " UNION ALL ".join(
    f"SELECT path, name, folder, type FROM {t}_n"
    for t in ("region", "nation", "customer", "supplier", "order", "part", "document"))
NEEDS = {"index_n": ["region_n", "nation_n", "customer_n", "supplier_n", "order_n", "part_n",
                     "document_n"]}


def twin(*names: str, body: str, **extra: str) -> str:
    """SQL text: the named shared table expressions, then extra ones, then the body."""
    order: list[str] = []
    for n in names:
        for m in [*NEEDS.get(n, []), n]:
            if m not in order:
                order.append(m)
    parts = [f"{n} AS ({CTE[n]})" for n in order] + [f"{n} AS ({q})" for n, q in extra.items()]
    return f"WITH RECURSIVE {', '.join(parts)} {body}" if parts else body
