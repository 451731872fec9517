"""What conditions are asked for: identities, typed results, groups, lookups, inverse maps, changes."""
