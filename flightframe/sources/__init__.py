"""Tables of samples from event tables, decoded messages and CSV logs."""
