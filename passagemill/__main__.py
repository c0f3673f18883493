from passagemill.cli import main

raise SystemExit(main())
