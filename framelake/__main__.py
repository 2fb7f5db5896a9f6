from framelake.api import main

raise SystemExit(main())
