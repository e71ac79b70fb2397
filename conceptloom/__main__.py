"""Command line: lattice, expand, compare, run, compile, datasets."""

from __future__ import annotations

import argparse
import json
import os
import sys

from conceptloom.session import local_session


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="conceptloom")
    sub = top.add_subparsers(dest="do", required=True)

    p = sub.add_parser("lattice", help="context file -> DOT")
    p.add_argument("csv")
    p.add_argument("out", help="a file name ending in .dot, or a folder for part files")
    p.add_argument("--delimiter")
    p.add_argument("--mode", default="strict", choices=("strict", "boolean", "lenient"))
    p.add_argument("--method", default="frontier", choices=("frontier", "auto", "subtree", "join"))
    p.add_argument("--order", default="intent")
    p.add_argument("--labels", default="reduced", choices=("reduced", "full"))
    p.add_argument("--color-by", default="own", choices=("own", "extent"))
    p.add_argument("--max-concepts", type=int)

    p = sub.add_parser("expand", help="DOT with reduced labels -> DOT with full labels")
    p.add_argument("dot")
    p.add_argument("out")
    p.add_argument("--statements", action="store_true", help="kept for old calls: any layout is read")
    p.add_argument("--loose-breaks", action="store_true", help="line breaks that are escaped twice, or as \\\\l")

    p = sub.add_parser("compare", help="exit 0 if two full DOT lattices are equivalent, else 1")
    p.add_argument("left")
    p.add_argument("right")
    p.add_argument("--json", action="store_true")
    p.add_argument("--quiet", action="store_true")
    p.add_argument("--statements", action="store_true", help="kept for old calls: any layout is read")
    p.add_argument("--loose-breaks", action="store_true", help="line breaks that are escaped twice, or as \\\\l")
    p.add_argument("--details", type=int, default=0, metavar="N", help="up to N differences of each kind, by name")

    p = sub.add_parser("run", help="execution, normalize, compare, report")
    p.add_argument("config")
    p.add_argument("run_dir")
    p.add_argument("--root", default=".")
    p.add_argument("--stages", nargs="*")
    p.add_argument("--resume", action="store_true")
    p.add_argument("--no-timeout", action="store_true")

    p = sub.add_parser("compile", help="many reports -> one table")
    p.add_argument("pattern")
    p.add_argument("out")
    p.add_argument("--first", default="")

    p = sub.add_parser("datasets", help="list context files below a folder")
    p.add_argument("root")
    return top


def differences(found, limit: int) -> dict[str, list[str]]:
    """Up to ``limit`` lines for each kind of difference of a comparison."""
    node = lambda s: f"(I: {s.i}, E: {s.e}) {', '.join(s.attrs)} | {', '.join(s.objs)}"
    few = lambda rows, *order: rows.orderBy(*order).limit(limit).collect()
    out = {
        "only left": [node(r.sig) for r in few(found.only_left(), "sig.i", "sig.e", "sig.attrs")],
        "only right": [node(r.sig) for r in few(found.only_right(), "sig.i", "sig.e", "sig.attrs")],
        "ambiguous": [f"{r.side} {r.id}: {node(r.sig)}" for r in few(found.ambiguous(), "side", "id")],
        "edges": [f"{r.side} only: {r.src} -> {r.dst}" for r in few(found.edge_differences(), "side", "src", "dst")],
        "pairs": [f"{r.common}: {r.left_id} = {r.right_id}" for r in few(found.correspondence(), "sig.i", "sig.e", "sig.attrs")],
    }
    return {k: v for k, v in out.items() if v}


def main(argv=None) -> int:
    a = parser().parse_args(argv)
    spark = local_session()
    # imported late so that --help needs no session
    from conceptloom.operators.compare import compare_graphs
    from conceptloom.plans import build, stages
    from conceptloom.sources import dot, files

    try:
        if a.do in ("lattice", "expand"):
            if a.do == "lattice":
                lines = build.context_to_dot(
                    spark, a.csv, a.delimiter, a.mode, a.method, a.order, a.labels, a.color_by, a.max_concepts
                )
            else:
                lines = build.expand_dot(spark, a.dot, a.loose_breaks)
            n = build.to_local_file(lines, a.out) if a.out.endswith(".dot") else dot.write_dot(lines, a.out)
            print(f"{n} lines -> {a.out}")
            return 0
        if a.do == "compare":
            graphs = [dot.read_dot(spark, p, loose_breaks=a.loose_breaks, free=True) for p in (a.left, a.right)]
            found = compare_graphs(*graphs)
            row = found.summary().first().asDict()
            if a.details:
                row["details"] = {k: list(map(str, v)) for k, v in differences(found, a.details).items()}
            if a.json:
                print(json.dumps(row, indent=2))
            elif a.quiet:
                print(str(row["equivalent"]).lower())
            else:
                print("\n".join(f"{k}: {v}" for k, v in row.items() if k != "details"))
                for kind, lines in row.get("details", {}).items():
                    print("\n".join([f"{kind}:", *(f"  {x}" for x in lines)]))
            return 0 if row["equivalent"] else 1
        if a.do == "run":
            ok = stages.run_stages(spark, a.config, a.run_dir, a.root, a.resume, a.stages, a.no_timeout)
            return 0 if ok else 1
        if a.do == "compile":
            text = stages.compiled_text(spark, a.pattern, os.path.basename(a.out), a.first)
            with open(a.out, "w", encoding="utf-8") as f:
                f.write(text)
            return 0
        for row in files.datasets(spark, a.root).toLocalIterator():
            print(f"{row.dataset_id}\t{row.path}")
        return 0
    except Exception as e:  # noqa: BLE001  any failure is exit status 1 with its reason
        print(f"error: {str(e).splitlines()[0] if str(e) else type(e).__name__}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
