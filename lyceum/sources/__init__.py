"""Where rows come from and how they enter the domain model."""
