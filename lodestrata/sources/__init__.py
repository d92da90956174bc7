"""Sources: file trees, project configuration, manifests."""
