"""Declared schemas of the raw files, so that no scan is spent on inference."""

EVENTS = "timestamp LONG, visitorid LONG, event STRING, itemid LONG, transactionid LONG"
ITEM_PROPERTIES = "timestamp LONG, itemid LONG, property STRING, value STRING"
CATEGORY_TREE = "categoryid LONG, parentid LONG"
RUNS = "run_id STRING, task_name STRING, rows_processed LONG, duration_seconds DOUBLE, status STRING, started_at TIMESTAMP, error_message STRING"

# The events and kinds of pairs that exist.
EVENT_KINDS = ("view", "addtocart", "transaction")
PAIR_KINDS = ("view", "purchase")
