"""``python -m bytequarry TASK INPUT_DIR [OUTPUT]``: runs a query, or all queries of a group, and prints or writes the results.

``python -m bytequarry --list`` names the tasks: queries, and the groups ``label``,
``corpus``, ``graph``, ``jump``, ``layer``, ``metric``, ``report`` and ``training``. A group's results go to folders of
their queries' names below OUTPUT; queries that fail are reported and the others go on.

``python -m bytequarry task NAME --flags`` runs a step over files, see ``bytequarry/tasks.py``.
"""

from __future__ import annotations

import argparse
import sys

from bytequarry.operators import steps
from bytequarry.plans import catalog
from bytequarry.session import local_session
from bytequarry.sources import io
from bytequarry.tasks import main as task_main


def groups() -> dict[str, list[str]]:
    """Queries by the module that they stand in."""
    found: dict[str, list[str]] = {}
    for name, plan in catalog.QUERIES.items():
        found.setdefault(plan.__module__.rpartition(".")[2].removesuffix("_queries"), []).append(name)
    return found


def main(argv: list[str] | None = None) -> int:
    argv = sys.argv[1:] if argv is None else argv
    if argv[:1] == ["task"]:
        return task_main(argv[1:])
    tasks = groups()
    parser = argparse.ArgumentParser(prog="bytequarry", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    parser.add_argument("task", nargs="?", choices=sorted([*catalog.QUERIES, *tasks]), metavar="TASK")
    parser.add_argument("input", nargs="?", help="directory of the input tables")
    parser.add_argument("output", nargs="?", help="Parquet path, or a folder for a group; without it the first rows are printed")
    parser.add_argument("--keep", action="store_true", help="do not replace an existing output")
    parser.add_argument("--list", action="store_true", help="name the tasks and stop")
    args = parser.parse_args(argv)
    if args.list:
        print("\n".join(f"{group}: {' '.join(sorted(names))}" for group, names in sorted(tasks.items())))
        return 0
    if not args.task or not args.input:
        parser.error("a task and an input directory are needed")
    spark, failed = local_session(), 0
    for name in sorted(tasks.get(args.task, [args.task])):
        try:
            df = catalog.QUERIES[name](spark, args.input)
            if args.output:
                print(io.write_parquet(df, f"{args.output}/{name}" if args.task in tasks else args.output, args.keep))
            else:
                print(name)
                df.show(20, truncate=60)
        except Exception as e:
            if args.task not in tasks:
                raise
            failed += 1
            print(f"{name}: {type(e).__name__}: {str(e).splitlines()[0]}", file=sys.stderr)
        finally:
            steps.release(spark)
    return int(failed > 0)


if __name__ == "__main__":
    sys.exit(main())
