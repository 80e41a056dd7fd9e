"""Reading captured pages and image bytes, writing results."""
