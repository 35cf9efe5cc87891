"""python -m veilspark.cli COMMAND: build-dictionary, build-synthetic, assess, submit, review, serve."""

from __future__ import annotations

import argparse
import sys

from veilspark.session import get_session
from veilspark.sources.store import Store


def _gate(spark, a):
    from veilspark.plans.gate import Gate

    return Gate(spark, a.data_dir, a.results, a.queue, a.audit, a.derived_dir, a.dict)


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="veilspark")
    sub = parser.add_subparsers(dest="command", required=True)
    p = sub.add_parser("build-dictionary")
    p.add_argument("data_dir")
    p.add_argument("--out")
    p = sub.add_parser("build-synthetic")
    p.add_argument("--dictionary", required=True)
    p.add_argument("--out", required=True)
    p.add_argument("--join-keys")
    p.add_argument("--id-pool-size", type=int, default=50)
    p = sub.add_parser("assess")
    p.add_argument("data_dir")
    p.add_argument("--out", required=True)
    p.add_argument("--report", required=True)
    for name in ("submit", "review", "serve"):
        p = sub.add_parser(name)
        for x in ("--audit", "--queue", "--results"):
            p.add_argument(x, required=True)
        p.add_argument("--data-dir", default=".")
        p.add_argument("--derived-dir")
        p.add_argument("--dict")
        if name == "submit":
            p.add_argument("job", help="a file of SQL, or a Python script (.py)")
            p.add_argument("--timeout", type=int)
            p.add_argument("--layer-name")
        if name == "review":
            p.add_argument("action", choices=["list", "approve", "reject"])
            p.add_argument("name", nargs="?")
        if name == "serve":
            p.add_argument("--token-file", required=True)
            p.add_argument("--bind", default="127.0.0.1")
            p.add_argument("--port", type=int, default=8765)
    a = parser.parse_args(argv)
    spark = get_session()
    if a.command == "build-dictionary":
        from veilspark.plans.dictionary import build

        print(f"{len(build(spark, a.data_dir, a.out)['files'])} files profiled")
    elif a.command == "build-synthetic":
        from veilspark.plans.dictionary import synthesize_dictionary

        keys = tuple(k.strip() for k in a.join_keys.split(",") if k.strip()) if a.join_keys else None
        print(f"{synthesize_dictionary(spark, a.dictionary, a.out, keys, a.id_pool_size)} samples written")
    elif a.command == "assess":
        from veilspark.plans.assessment import assess

        report = assess(spark, a.data_dir, a.out, a.report)
        print(f"reid_pass={report['reid_pass']} leaks={len(report['reid_leaks'])}")
    elif a.command == "submit":
        from veilspark.plans.scripts import Script

        job = Script.read(spark, a.job) if a.job.endswith(".py") else Store(spark).read(a.job)
        result = _gate(spark, a).submit(job, a.timeout, a.layer_name)
        print(result.message)
        return int(result.status == "error")
    elif a.command == "review":
        gate = _gate(spark, a)
        if a.action == "list":
            print("\n".join(gate.pending()))
        elif a.action == "approve":
            print("approved:", gate.approve(a.name))
        else:
            gate.reject(a.name)
            print("rejected:", a.name)
    else:
        from veilspark.service import make_server

        make_server(_gate(spark, a), Store(spark).read(a.token_file).strip(), a.bind, a.port).serve_forever()
    return 0


if __name__ == "__main__":
    sys.exit(main())
