"""``python -m factweave query NAME --data DIR`` runs a named query; ``build``, ``stats`` and ``search`` work on stored graphs."""

from __future__ import annotations

import argparse
import sys

from factweave.session import get_spark


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="factweave")
    sub = p.add_subparsers(dest="command", required=True)
    q = sub.add_parser("query", help="run a named query")
    q.add_argument("name")
    q.add_argument("--data", required=True)
    q.add_argument("--rows", type=int, default=20)
    b = sub.add_parser("build", help="discover edges over stored nodes and embeddings; exit 0 when connected")
    b.add_argument("--graph", required=True)
    b.add_argument("--out", required=True)
    for name in ("stats", "search"):
        s = sub.add_parser(name)
        s.add_argument("--graph", required=True)
        if name == "search":
            s.add_argument("text")
    a = p.parse_args(argv)
    spark = get_spark()
    if a.command == "query":
        from factweave.plans import catalog

        catalog.load()
        if a.name not in catalog.QUERIES:
            print("unknown query; known:", ", ".join(sorted(catalog.QUERIES)), file=sys.stderr)
            return 2
        catalog.QUERIES[a.name](spark, a.data).show(a.rows, truncate=80)
        return 0
    from factweave.plans.service import KnowledgeGraph
    from factweave.sources import graph_store

    if a.command == "build":
        from factweave.plans.build import build_graph

        nodes = spark.read.schema(graph_store.NODE).parquet(f"{a.graph}/nodes")
        graph = build_graph(nodes, graph_store.read_vectors(spark, a.graph), skip_failing=True)
        graph_store.write_graph(graph.nodes, graph.edges, a.out)
        summary = graph.summary()
        graph_store.write_stats(summary, a.out)
        return 0 if summary.first()["is_connected"] else 1
    graph = KnowledgeGraph.open(spark, a.graph)
    (graph.stats() if a.command == "stats" else graph.search(a.text)).show(truncate=80)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
