"""python -m tessella series SPEC.json | python -m tessella check CODECS.json: plan a pipeline, or check one."""

from __future__ import annotations

import json
import sys

from .plans.codecs import validated
from .plans.series import SeriesSpec, codec_series
from .types import InvalidArgument, Unsupported


def main(args: list[str]) -> int:
    if len(args) != 2 or args[0] not in ("series", "check"):
        print(__doc__, file=sys.stderr)
        return 2
    try:
        with open(args[1]) as f:
            given = json.load(f)
        out = codec_series(SeriesSpec.from_dict(given)) if args[0] == "series" else [validated(c) for c in given]
    except (InvalidArgument, Unsupported) as e:
        print(f"refused: {e}", file=sys.stderr)
        return 1
    print(json.dumps(out, indent=2))
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
