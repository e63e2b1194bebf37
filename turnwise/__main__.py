"""``python -m turnwise QUERY --data FOLDER [--out PATH] [--n-boot N ...]``: run one query of the catalogue."""

from __future__ import annotations

import argparse
from dataclasses import fields

from turnwise.plans import nested_queries, queries
from turnwise.plans.corpus import Params
from turnwise.session import local_session
from turnwise.sources.reports import markdown


def main(arguments: list[str] | None = None) -> None:
    retrieval, nested = queries.queries(), nested_queries.queries()
    args = argparse.ArgumentParser(prog="turnwise")
    args.add_argument("query", choices=sorted(retrieval | nested))
    args.add_argument("--data", required=True, help="folder of Parquet tables")
    args.add_argument("--out", help="folder for the result as Parquet; without it a small result is printed")
    for f in fields(Params):  # the retrieval queries' parameters, such as --n-boot and --alpha
        args.add_argument("--" + f.name.replace("_", "-"), type=type(f.default), default=f.default)
    a = args.parse_args(arguments)
    chosen = {f.name: getattr(a, f.name) for f in fields(Params)} if a.query in retrieval else {}
    df = (retrieval | nested)[a.query](local_session(), a.data, **chosen)
    if a.out:
        df.write.parquet(a.out)
    else:
        print(markdown(df))


if __name__ == "__main__":
    main()
