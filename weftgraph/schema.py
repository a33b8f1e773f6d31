"""Types of the graph's tables, and the closed sets of node and edge types."""

from __future__ import annotations

NODES = (
    "id long, type string, code string, name string, function_id long, is_cfg boolean, child_num int, operator string, line int, col int, start_idx int, "
    "stop_idx int, filepath string, base_type string, complete_type string, identifier string, test_id string, hidden boolean"
)
EDGES = "src long, dst long, etype string, var string, flow_label string, function_id long, test_id string"

# The types of edges.
EDGE_TYPES = [
    "IS_PARENT_DIR_OF", "IS_FILE_OF", "IS_FUNCTION_OF_AST", "IS_AST_PARENT", "IS_FUNCTION_OF_CFG", "FLOWS_TO", "IS_CLASS_OF", "DECLARES", "IS_ARG", "DEF", "USE", "REACHES", "POST_DOM",
    "CONTROLS",
]
