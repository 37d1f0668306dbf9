"""``python -m paperloom < records.json > originals.json``: marks duplicates in a JSON array of records, in its order."""

from __future__ import annotations

import json
import sys


def main(read=sys.stdin, write=sys.stdout) -> None:
    from paperloom.operators.dedup import deduplicate
    from paperloom.session import local_session

    records = json.load(read)
    spark = local_session("deduplicate")
    rows = [(i, str(r.get("doi") or ""), str(r.get("title") or "")) for i, r in enumerate(records)]
    found = deduplicate(spark.createDataFrame(rows, "ord bigint, doi string, title string")).where("duplicate_of is not null")
    for r in found.collect():  # the array is in the driver's memory as it is
        records[r.ord] |= {"duplicate_of": records[r.duplicate_of].get("id", ""), "screening_status": "duplicate"}
    json.dump(records, write, ensure_ascii=False, indent=2)


if __name__ == "__main__":
    main()
