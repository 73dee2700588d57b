"""DataFrame operators: roll-ups, affinity, insights, presentation, report scope, parameters, news."""
