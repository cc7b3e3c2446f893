"""Every operator applied to the test tables, each next to its SQL.

The tables hold no source code, so the queries derive code-shaped rows from
them: a part is a file, a line item is a call or a flow, an order is a
function. The derivations are projections of whole tables.
"""

from flowtide.lens.common import QUERIES


def load() -> dict:
    from flowtide.lens import chain, classify, graphs, places, reports, resolution  # noqa: F401

    return QUERIES
