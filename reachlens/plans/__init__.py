"""Whole jobs: the weekly build, the dashboard request, report parameters, and the registered queries."""
