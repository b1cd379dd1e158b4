"""Reading and writing: collections, pages, logs and manifests."""
