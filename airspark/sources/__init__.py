"""Where rows come from and go to: payloads, the feature store, exports."""
