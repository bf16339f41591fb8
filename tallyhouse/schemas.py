"""Explicit schemas of the vote domain."""

VOTE = "struct<fingerprint:string,option_id:bigint>"
BATCH = f"poll_id string, worker_id string, done boolean, votes array<{VOTE}>"
MESSAGE = "topic string, partition int, offset bigint, key binary, value binary"
RESULT = "struct<total:bigint,options:array<struct<option_id:bigint,count:bigint>>,workers_seen:bigint,workers_done:bigint>"
POLL = f"id string, question string, options array<struct<id:int,text:string>>, status string, results {RESULT}, created_at timestamp, ends_at timestamp"
VOTES = "poll_id string, fingerprint string, option_id bigint, worker_id string, seq bigint"
FINAL = "poll_id string, option_id bigint, count bigint, total bigint, workers_seen bigint, workers_done bigint, reason string"
