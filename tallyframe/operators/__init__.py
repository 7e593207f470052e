"""Set-based ledger operators."""
