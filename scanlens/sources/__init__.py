"""Where observations come from: pages of a web API, dumps, CSV reports."""
