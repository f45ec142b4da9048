"""Where event tables come from."""
