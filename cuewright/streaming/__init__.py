"""The same operators over streams: job queues, sessions, ledger appends."""
