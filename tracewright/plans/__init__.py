"""The service's calls and the registered queries."""
