"""Row types of the flow tables.

Expression trees nest without bound, which a Spark struct cannot. They are
kept as one flat node table: every row knows its own position (uid, pre-order
within the file) and carries the few facts about its parent and receiver that
later steps need, so that deriving edges and tags is a projection, not a join.
"""

IR_NODE = """
    file_path string, fn_id string, fn_ord int, uid bigint, node_id string, kind string,
    name string, target string, value string, value_type string, path array<string>,
    line int, is_async boolean, stmt_line int, stmt_kind string,
    parent_uid bigint, parent_id string, parent_kind string, parent_target string,
    slot string, ord int, n_args int,
    receiver_kind string, receiver_text string, receiver_root string, receiver_path array<string>,
    root_kind string, root_name string,
    in_condition boolean, in_access boolean, in_path boolean, conditions array<int>, text string
"""

EDGE = """
    source_id string, target_id string, transform string, conditions array<int>, confidence double
"""

TAG = "kind string, node_id string"

CALL_RESOLUTION = """
    call_id string, resolved_fn_id string, candidates array<string>, confidence double,
    receiver_type string
"""
