"""Command line: ``query`` runs a query, ``catalog`` builds a configuration from sources, ``serve`` answers over HTTP."""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from .engine import Engine
from .plans.catalog import Catalog

COLUMNS = ("qname", "decompositionTime", "planningTime", "firstResult", "overallExecTime", "status", "cardinality")


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser("semlake", description=__doc__)
    parser.add_argument("--master", help="a Spark master; the session's own otherwise")
    commands = parser.add_subparsers(dest="command", required=True)
    query = commands.add_parser("query")
    query.add_argument("-c", "--config", required=True)
    query.add_argument("-q", "--query", required=True, help="a file, or the query itself")
    query.add_argument("-s", "--summary", action="store_true", help="one line of timings instead of the rows")
    query.add_argument("-o", "--output", help="a folder for the rows as TSV")
    query.add_argument("-e", "--explain", action="store_true")
    catalog = commands.add_parser("catalog")
    catalog.add_argument("-s", "--sources", required=True, help="a configuration with datasources only")
    catalog.add_argument("-o", "--output", required=True)
    serve_ = commands.add_parser("serve")
    serve_.add_argument("-c", "--config", required=True)
    serve_.add_argument("-p", "--port", type=int, default=5000)
    given = parser.parse_args(args)

    from pyspark.sql import SparkSession

    builder = SparkSession.builder.appName("semlake").config("spark.python.sql.dataFrameDebugging.enabled", "false")  # plans are built faster without stack traces
    spark = (builder.master(given.master) if given.master else builder).getOrCreate()
    if given.command == "catalog":
        from .plans.discovery import discover

        config = json.loads(Path(given.sources).read_text())
        config = config if isinstance(config, dict) else {"datasources": config}
        made = discover(spark, Catalog.from_json(config, Path(given.sources).parent)).to_json()
        # mappings and parameters are the user's; they stay as they were given
        made["datasources"] = config.get("datasources", [])
        Path(given.output).write_text(json.dumps(made, indent=2))
        return 0
    engine = Engine(spark, Catalog.from_json(given.config))
    if given.command == "serve":
        from .service import serve

        server = serve(engine, "0.0.0.0", given.port)
        try:
            server.serve_forever()
        except KeyboardInterrupt:
            server.server_close()
        return 0
    path = Path(given.query)
    is_file = len(given.query) < 1000 and path.is_file()
    result = engine.query(path.read_text() if is_file else given.query)
    if given.explain:
        print(result.explain(physical=True))
    elif given.output:
        result.write_tsv(given.output)
    elif given.summary:
        line = result.summary(path.name if is_file else "query")
        print("\t".join(str(line[c]) for c in COLUMNS))
    else:
        print("\t".join(result.vars))
        for row in result.stream():
            print("\t".join("" if x is None else str(x) for x in row))
    return 0


if __name__ == "__main__":
    sys.exit(main())
