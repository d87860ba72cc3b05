"""Plan-level building blocks: dense id assignment, change-batch helpers
(first valid claim, reasons, last value wins), presentation order and
plan inspection."""
