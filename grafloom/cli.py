"""`python -m grafloom.cli`: init, run, explain, profile, import-rdf, compact, pack, unpack, diff, view."""

from __future__ import annotations

import argparse
import sys

from grafloom.database import Database, Result
from grafloom.plans.runtime import session
from grafloom.sources import export


def main(argv: list[str] | None = None) -> int:
    """0; for `diff` 1 if the databases differ; 2 on an error."""
    p = argparse.ArgumentParser(prog="grafloom")
    sub = p.add_subparsers(dest="command", required=True)
    for name, args in {"init": ["path"], "run": ["path", "script"], "explain": ["path", "script"], "profile": ["path", "script"], "compact": ["path"], "import-rdf": ["path", "file"], "pack": ["path", "file"], "unpack": ["file", "path"], "diff": ["path", "other"], "view": ["path"]}.items():
        s = sub.add_parser(name)
        for a in args:
            s.add_argument(a)
    a = p.parse_args(argv)
    try:
        if a.command == "pack":
            print(export.pack(a.path, a.file), "files")
            return 0
        if a.command == "unpack":
            export.unpack(a.file, a.path)
            return 0
        spark = session("grafloom-cli")
        spark.sparkContext.setLogLevel("ERROR")
        db = Database(spark, a.path)
        if a.command == "init":
            db.commit()
        elif a.command == "run":
            for r in db.execute(a.script):
                for row in r.rows() if isinstance(r, Result) else [r]:
                    print(row)
            db.commit()
        elif a.command == "explain":
            print(db.explain(a.script)["plan"])
        elif a.command == "profile":
            p = db.profile(a.script)
            print(p["rows"], "rows", round(p["seconds"], 3), "s")
            for o in p["operators"]:
                print("  " * o["depth"] + o["operator"], o["rows"] if o["rows"] is not None else "")
        elif a.command == "compact":
            for n in db.store.names():
                db.store.compact(n)
            db.commit()
        elif a.command == "import-rdf":
            print(db.import_ntriples(a.file))
        elif a.command == "view":
            for n, df in db.tables.items():
                print(n, df.count(), ", ".join(df.columns))
        elif a.command == "diff":
            rows = export.diff(db.graph, Database(spark, a.other).graph).collect()
            for r in rows:
                print(r.asDict())
            return int(any(r["only_a"] or r["only_b"] or r["schema_changed"] for r in rows))
    except Exception as e:  # noqa: BLE001
        print(e, file=sys.stderr)
        return 2
    return 0


if __name__ == "__main__":
    sys.exit(main())
